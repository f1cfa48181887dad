"""How filters of documents interact: what each removes in every order, from a sparse document-term matrix.

Texts are read once, into shards of a compressed sparse row matrix: for every document the numbers of its words and how often
each occurs. A shard numbers words by itself and carries the list of them; lists of all shards together give the dictionary, where a word has one number in the whole
corpus, and the shards are rewritten with these numbers. Row sums and numbers of nonzero entries decide the filters on words; what a text alone
tells (capitals, symbols, a digest) is noted beside its row. Only a shard's distinct words, not the words of each document, are shuffled to
number them: they are split into slots by hash, as many as keep a slot small, and a word that every document has is in its slot once a shard.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import staged, table

SHARD_ENTRIES = 1 << 18
SHARD_ROWS = 1 << 16
SLOT_WORDS = 1 << 18
SLICE = 64
PIECE = 1 << 20
FILTERS = "ABCDE"
_BYTES = bytes(range(256))
NOT_CAPITALS = _BYTES.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
CONTINUED = bytes(range(0x80, 0xC0))
SYMBOLS = re.compile(rb"[#$%&*|]")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def term_counts(raw: bytes) -> Counter:
    """How often each word occurs; of a very long text, pieces of about a million bytes at a time are split."""
    if len(raw) <= PIECE:
        return Counter(raw.split())
    found: Counter = Counter()
    at = 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + PIECE)
        end = gap.end() if gap else len(raw)
        found.update(raw[at:end].split())
        at = end
    return found


def packed(values) -> bytes:
    """Whole numbers from 0 in as many bytes each as the largest needs, all lowest bytes first, then all second ones, and so on: most of the higher ones are 0 and compress well."""
    a = np.asarray(values, "<u4")
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """The `n` numbers of `packed`."""
    planes = np.frombuffer(raw, np.uint8).reshape(-1, n) if n else np.zeros((0, 0), np.uint8)
    out = np.zeros(n, np.int64)
    for k, plane in enumerate(planes):
        out |= plane.astype(np.int64) << (8 * k)
    return out


def local_shards(docs: DataFrame, *, entries: int = SHARD_ENTRIES) -> DataFrame:
    """shard, doc_ids, parts, digests, capitals, symbols (a list each, one entry a document), starts (64-bit, binary), terms, counts (see `packed`), words
    (the shard's own dictionary): the matrix of `docs` (doc_id, part, text), cut where they are read into shards of about `entries` nonzero entries."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"shard long, doc_ids array<{id_type}>, parts array<string>, digests array<binary>, capitals array<boolean>, symbols array<boolean>, starts binary, terms binary, counts binary, words array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        key_type = pa.int64()

        def fresh():
            return [], [], [], [], [], [0], array("I"), array("I"), {}

        held = fresh()

        def batch() -> pa.RecordBatch:
            ids, parts, digests, capitals, symbols, starts, terms, counts, words = held
            lists = (pa.array([ids], pa.list_(key_type)), pa.array([parts], pa.list_(pa.string())), pa.array([digests], pa.list_(pa.binary())), pa.array([capitals], pa.list_(pa.bool_())), pa.array([symbols], pa.list_(pa.bool_())))
            numbers = (pa.array([np.array(starts, "<i8").tobytes()]), pa.array([packed(terms)]), pa.array([packed(counts)]))
            names = ["shard", "doc_ids", "parts", "digests", "capitals", "symbols", "starts", "terms", "counts", "words"]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, *numbers, pa.array([list(words)], pa.list_(pa.string()))], names=names)

        for b in batches:
            key_type = b.column(0).type
            for at in range(0, b.num_rows, SLICE):  # few texts at a time are Python objects
                part = b.slice(at, SLICE)
                for key, name, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()):
                    ids, parts, digests, capitals, symbols, starts, terms, counts, words = held
                    found = term_counts(raw)
                    ids.append(key), parts.append(name), digests.append(hashlib.sha256(raw).digest())
                    points = len(raw.translate(None, CONTINUED))
                    capitals.append(100 * len(raw.translate(None, NOT_CAPITALS)) > 10 * points)
                    symbols.append(SYMBOLS.search(raw) is not None)
                    terms.extend(words.setdefault(w, len(words)) for w in found)
                    counts.extend(found.values())
                    starts.append(len(terms))
                    if len(terms) >= entries or len(ids) >= SHARD_ROWS:
                        yield batch()
                        number, held = number + 1, fresh()
        if held[0]:
            yield batch()

    return docs.select("doc_id", "part", "text").mapInArrow(run, schema)


def word_slots(shards: DataFrame) -> DataFrame:
    """shard, slot, local (places in the shard's list, packed), words: the words of every shard, split by hash into slots of about SLOT_WORDS of all shards together."""
    pairs = shards.agg(F.sum(F.size("words"))).first()[0] or 0
    slots = max(8, -(-pairs // SLOT_WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                words = b.column(1).slice(k, 1).flatten()
                of = np.fromiter((zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words)) % slots
                order = np.argsort(of, kind="stable")
                found, starts = np.unique(of[order], return_index=True)
                ends = np.append(starts[1:], len(order))
                local = [packed(order[x:y]) for x, y in zip(starts, ends)]
                listed = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), words.take(pa.array(order)))
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(found), pa.int64()), pa.array(found, pa.int32()), pa.array(local, pa.binary()), listed], names=["shard", "slot", "local", "words"])

    return shards.select("shard", "words").mapInArrow(run, "shard long, slot int, local binary, words array<string>")


def numbered_slots(slots: DataFrame) -> DataFrame:
    """shard, slot, n (words of the shard in the slot), local, inside (their numbers in the slot, from 0, packed), size (words of the slot) and, in one row a slot, its dictionary.

    A slot is numbered in one task. It has about SLOT_WORDS words of all shards, and no word more than once a shard."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        words = t.column("words").chunk(0) if t.num_rows else pa.array([], pa.list_(pa.string()))
        coded = words.flatten().dictionary_encode()
        numbers, ends = coded.indices.to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum(np.append(0, words.value_lengths().to_numpy(zero_copy_only=False)))
        inside = [packed(numbers[x:y]) for x, y in zip(ends, ends[1:])]
        first = [coded.dictionary.to_pylist(), *[None] * (t.num_rows - 1)]
        size = pa.array([len(coded.dictionary)] * t.num_rows, pa.int64())
        return pa.table([t.column("shard"), t.column("slot"), pa.array(np.diff(ends), pa.int64()), t.column("local"), pa.array(inside, pa.binary()), size, pa.array(first, pa.list_(pa.string()))], names=["shard", "slot", "n", "local", "inside", "size", "dictionary"])

    return slots.groupBy("slot").applyInArrow(run, "shard long, slot int, n long, local binary, inside binary, size long, dictionary array<string>")


@dataclass(frozen=True)
class Rows:
    """A shard with the corpus's numbers of words: where each row starts, its terms in order, and their counts."""

    starts: np.ndarray
    terms: np.ndarray
    counts: np.ndarray


def renumbered(own: pa.Table, numbers: pa.Table) -> Rows:
    """The one shard in `own`, its words numbered as the rows of `numbers` (n, local, inside, base) say."""
    pairs = list(zip(*(numbers.column(c).to_pylist() for c in ("n", "local", "inside", "base"))))
    to = np.empty(sum(n for n, *_ in pairs), np.int64)
    for n, local, inside, base in pairs:
        to[unpacked(local, n)] = unpacked(inside, n) + base
    starts = np.frombuffer(own.column("starts")[0].as_py(), "<i8")
    terms, counts = (unpacked(own.column(c)[0].as_py(), int(starts[-1])) for c in ("terms", "counts"))
    terms = to[terms]
    order = np.argsort((np.repeat(np.arange(len(starts) - 1), np.diff(starts)) << 43) | terms)
    return Rows(starts, terms[order], counts[order])


class Matrix:
    """The sparse matrix of `docs` (doc_id, part, text), in shards."""

    def __init__(self, docs: DataFrame, *, entries: int = SHARD_ENTRIES):
        self.shards = staged(local_shards(docs, entries=entries), "shards")
        numbered = staged(numbered_slots(word_slots(self.shards)), "numbers")
        before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # a row a slot
        bases = numbered.groupBy("slot").agg(F.max("size").alias("size")).select("slot", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
        self.numbers = numbered.join(bases, "slot")

    def dictionary(self) -> DataFrame:
        """word, term: numbers from 0 without a gap."""
        words = self.numbers.where("dictionary is not null").select("base", F.posexplode("dictionary").alias("at", "word"))
        return words.select("word", (F.col("base") + F.col("at")).alias("term"))

    def _each(self, columns: list[str], make: Callable[[pa.Table, Rows], pa.Table], schema: str) -> DataFrame:
        """What `make` gives of every shard: its columns, and its rows in the numbers of the dictionary."""
        body = self.shards.select("shard", *columns, "starts", "terms", "counts")
        numbers = self.numbers.select("shard", "n", "local", "inside", "base")

        def run(own: pa.Table, numbers: pa.Table) -> pa.Table:
            return make(own, renumbered(own, numbers)) if own.num_rows else pa.table([])

        return body.groupBy("shard").cogroup(numbers.groupBy("shard")).applyInArrow(run, schema)

    def csr(self) -> DataFrame:
        """shard, doc_ids, starts, terms (64-bit each), counts (32-bit): little-endian binary; row k of a shard is from starts[k] to starts[k + 1], its terms in order."""
        key = self.shards.schema["doc_ids"].dataType.simpleString()

        def make(own: pa.Table, rows: Rows) -> pa.Table:
            made = [pa.array([a.astype(k).tobytes()]) for a, k in ((rows.starts, "<i8"), (rows.terms, "<i8"), (rows.counts, "<u4"))]
            return pa.table([own.column("shard"), own.column("doc_ids"), *made], names=["shard", "doc_ids", "starts", "terms", "counts"])

        return self._each(["doc_ids"], make, f"shard long, doc_ids {key}, starts binary, terms binary, counts binary")

    def totals(self) -> DataFrame:
        """doc_id, part, digest, capitals, symbols, n_words (row sum), n_distinct (nonzero entries): a row for every document."""
        key = self.shards.schema["doc_ids"].dataType.elementType.simpleString()
        lists = ["doc_ids", "parts", "digests", "capitals", "symbols"]

        def make(own: pa.Table, rows: Rows) -> pa.Table:
            sums = np.append(0, np.cumsum(rows.counts, dtype=np.int64))
            noted = [own.column(c).combine_chunks().flatten() for c in lists]
            return pa.table([*noted, pa.array(sums[rows.starts[1:]] - sums[rows.starts[:-1]]), pa.array(np.diff(rows.starts))], names=["doc_id", "part", "digest", "capitals", "symbols", "n_words", "n_distinct"])

        return self._each(lists, make, f"doc_id {key}, part string, digest binary, capitals boolean, symbols boolean, n_words long, n_distinct long")


def failed_filters(docs: DataFrame, *, least_words: int = 100, least_distinct: int = 80, entries: int = SHARD_ENTRIES) -> DataFrame:
    """doc_id, part, n_words, n_distinct, failed (letters of the filters that the document fails), a row for every row of `docs` (doc_id, lang, text).

    A: under `least_words` words. B: under `least_distinct` percent of them differ. C: capitals A to Z are over a tenth of the code points. D: a symbol
    of #$%&*|. E: the text of a smaller doc_id, in the whole table, is the same. Null and empty texts are equal and have no words, so they fail A only, and E; a null lang
    is the empty part. A null doc_id never fails E, nor makes another fail; repeated rows fail it together or not at all. A very long
    text is a shard of its own. Extra columns are not read; an empty table gives no rows.
    """
    named = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    matrix = Matrix(named, entries=entries)
    texts = matrix.shards.select(F.inline(F.arrays_zip(F.col("digests").alias("digest"), F.col("doc_ids").alias("doc_id"))))
    firsts = texts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = matrix.totals().join(staged(firsts, "firsts"), "digest", "left")
    fails = {
        "A": F.col("n_words") < least_words,
        "B": 100 * F.col("n_distinct") < least_distinct * F.col("n_words"),
        "C": F.col("capitals"),
        "D": F.col("symbols"),
        "E": F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)),
    }
    return rows.select("doc_id", "part", "n_words", "n_distinct", F.concat(*[F.when(c, k).otherwise("") for k, c in fails.items()]).alias("failed"))


def interactions(failed: DataFrame, labels: DataFrame, *, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and counts, a row for every part of `failed` (doc_id, part, failed), order of the filters and step in it.

    Of a part's documents: kept after the step, removed in it, redundant (fail its filter, removed before), unique_fails (fail its
    filter only), good_lost and toxic_lost (removed in it, with quality 1 or toxic 1 in `labels`), shapley (removed by its filter, over all orders).
    A doc_id with several labels counts as good, or toxic, if any says so. Documents that fail the same filters are counted once and then played through all orders.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = failed.join(known, "doc_id", "left")
    groups = joined.groupBy("part", "failed").agg(F.count("*").alias("n"), F.count_if(F.coalesce("good", F.lit(False))).alias("n_good"), F.count_if(F.coalesce("toxic", F.lit(False))).alias("n_toxic"))
    orders = ["".join(p) for p in permutations(filters)]
    each = groups.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.array(*map(F.lit, range(1, len(filters) + 1)))))
    each = each.withColumn("own", F.expr("substring(filter_order, step, 1)")).withColumn("left", F.expr("translate(failed, substring(filter_order, 1, step - 1), '')"))
    fails, before = F.instr("failed", F.col("own")) > 0, F.col("left") != F.col("failed")
    here = fails & ~before
    total = lambda yes, n="n": F.coalesce(F.sum(F.when(yes, F.col(n))), F.lit(0)).cast("long")
    # of the orders of a document's failing filters each is first equally often
    share = F.sum(F.when(fails, F.col("n") * F.expr(f"{len(orders)} div length(failed)")))
    return each.groupBy("part", "filter_order", "step").agg(
        total(~here & ~before).alias("kept"), total(here).alias("removed"), total(fails & before).alias("redundant"), total(F.col("failed") == F.col("own")).alias("unique_fails"),
        total(here, "n_good").alias("good_lost"), total(here, "n_toxic").alias("toxic_lost"), F.coalesce(share, F.lit(0)).cast("long").alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir):
    return interactions(failed_filters(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS copy FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN copy THEN 'E' ELSE '' END AS failed FROM w),
l AS (SELECT doc_id, max(quality) AS good, max(toxic) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
g AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good = 1) AS n_good, count(*) FILTER (bad = 1) AS n_bad FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, CASE WHEN step = 1 THEN '' ELSE filter_order[1:step - 1] END AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
y AS (SELECT *, contains(failed, own) AS fails, translate(failed, before, '') <> failed AS earlier FROM g, s)
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(n_good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(n_bad) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(len(failed), 1)) FILTER (fails), 0)::BIGINT AS shapley
FROM y GROUP BY part, filter_order, step
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {"op13_filter_audit": OP13_SQL}
