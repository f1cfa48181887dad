"""Substring dedup by winnowed seeds and window hashes.

Seeds: runs of `SEED_WORDS` words, winnowed so that every window of `window` words selects exactly one, the one with
the least hash, and equal windows select the same. Seeds that occur once are dropped. Nothing is
extended pair by pair: every window that selects a seed which occurs again is hashed, and windows are grouped by two 64-bit
hashes. This finds the words that an extension of `window` words or more would cover, and a passage in m documents
costs m rows, never m * m pairs. A reported span is a union of covered words; where different repeats touch or overlap, it joins them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged, table

WINDOW = 35
SEED_WORDS = 8
#: Odd factors of the two rolling hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Rolling:
    """Hashes of every run of words of a text: sums of word hash times factor^place, brought to a common place."""

    def __init__(self, factor: int):
        self.factor, self.inverse = factor, pow(factor, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            grow = 2 * n
            for name, f in (("up", self.factor), ("down", self.inverse)):
                p = np.full(grow, f, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def of(self, hashes: np.ndarray, width: int) -> np.ndarray:
        n = len(hashes)
        self._powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.up[:n], out=total[1:])
        return (total[width:] - total[: n - width + 1]) * self.down[: n - width + 1]


def selected(hashes: np.ndarray, rolling: Rolling, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes at every place, and for every window the place of the seed it selects."""
    seeds = rolling.of(hashes, SEED_WORDS)
    view = sliding_window_view(seeds, window - SEED_WORDS + 1)
    return seeds, view.argmin(axis=1) + np.arange(len(view))


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


_NONE = np.zeros(0, np.int64)


def _seed_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(FACTORS[0])
        for b in batches:
            count, whole, seeds, places = [], [], [], []
            for raw in b.column(3).cast(pa.binary()).to_pylist():
                words = (raw or b"").split()
                count.append(len(words))
                whole.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) < window:
                    seeds.append(_NONE), places.append(_NONE)
                    continue
                h, at = selected(word_hashes(words), rolling, window)
                at = np.unique(at)
                seeds.append(_signed(h[at])), places.append(at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(count, pa.int64()), pa.array(whole, pa.string()), _lists(seeds, pa.int64()), _lists(places, pa.int32())],
                names=["doc_id", "d1", "d2", "n_words", "whole", "seeds", "places"],
            )

    return run


def _extend_rows(window: int):
    """For texts with seeds that occur again: the windows that select one of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = (Rolling(f) for f in FACTORS)
        for b in batches:
            starts, w1, w2 = [], [], []
            for raw, again in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
                hashes = word_hashes(raw.split())
                _, at = selected(hashes, one, window)
                here = np.flatnonzero(np.isin(at, np.array(again)))
                starts.append(here)
                w1.append(_signed(one.of(hashes, window)[here])), w2.append(_signed(two.of(hashes, window)[here]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), _lists(starts, pa.int32()), _lists(w1, pa.int64()), _lists(w2, pa.int64())],
                names=["d1", "d2", "text", "starts", "w1", "w2"],
            )

    return run


def _cut_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, kept, spans = [], [], []
            for raw, starts in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
                words = raw.split()
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, starts, 1)
                np.add.at(edge, np.array(starts) + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
                spans.append([{"first": int(f), "after": int(a)} for f, a in zip(turn[::2], turn[1::2])])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)],
                names=["d1", "d2", "n_removed", "kept_text", "repeats"],
            )

    return run


def remove_repeats(docs: DataFrame, *, window: int = WINDOW) -> dict[str, DataFrame]:
    """Words of `docs` (doc_id, text) covered by a window of `window` words that also starts elsewhere.

    {"documents": doc_id, n_words, n_removed, kept_sha256 for every input row; "texts": d1, d2, n_removed,
    kept_text, repeats (word spans that repeated windows cover) for each distinct text that shares a window with another or itself}.
    d1, d2 are xxhash64 of the text, and of 1 and the text. Null and empty texts have no words. Copies of a
    text are handled once, and lose all their words when they have `window` or more; a text that
    is shorter than that loses none. Repeated rows count as copies. Other columns are not read.
    """
    if window <= SEED_WORDS:
        raise ValueError(f"window must be above {SEED_WORDS}")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"), "text")
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    rows = staged(
        keyed.mapInArrow(_seed_rows(window), f"doc_id {id_type}, d1 long, d2 long, n_words long, whole string, seeds array<long>, places array<int>"), "seeds"
    )
    # written, so that the joins below have nothing but a shuffle on either side, which Spark can split where a seed or window is hot
    again = rows.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    again = staged(again, "again")
    at = rows.select("doc_id", "d1", "d2", F.explode(F.arrays_zip("seeds", "places")).alias("s"))
    at = at.select("doc_id", "d1", "d2", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    hits = at.join(again, "seed").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.collect_set("place").alias("again"))
    hits = staged(hits, "hits")
    # one row of each text: where rows have the same doc_id and text, more are harmless, as copies lose all words anyway
    texts = keyed.join(hits, ["d1", "d2"]).where(F.col("doc_id").eqNullSafe(F.col("first"))).select("d1", "d2", "text", "again")
    windows = staged(
        texts.mapInArrow(_extend_rows(window), "d1 long, d2 long, text string, starts array<int>, w1 array<long>, w2 array<long>"), "windows"
    )
    each = windows.select("d1", "d2", F.explode(F.arrays_zip("starts", "w1", "w2")).alias("w")).select(
        "d1", "d2", F.col("w.starts").alias("start"), F.col("w.w1").alias("w1"), F.col("w.w2").alias("w2")
    )
    shared = staged(each.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "shared")
    starts = staged(each.join(shared, ["w1", "w2"]).groupBy("d1", "d2").agg(F.collect_set("start").alias("starts")), "starts")
    cut = (
        windows.select("d1", "d2", "text")
        .join(starts, ["d1", "d2"])
        .select("d1", "d2", "text", "starts")
        .mapInArrow(_cut_rows(window), "d1 long, d2 long, n_removed long, kept_text string, repeats array<struct<first:int,after:int>>")
    )
    cut = staged(cut, "repeats")
    copies = rows.groupBy("d1", "d2").agg(F.count("*").alias("copies"))
    parts = cut.groupBy("d1", "d2").agg(F.max("n_removed").alias("part"), F.max(F.sha2("kept_text", 256)).alias("rest"))
    known = staged(copies.join(parts, ["d1", "d2"], "left").where("copies > 1 or part > 0"), "known")
    all_gone = (F.col("copies") > 1) & (F.col("n_words") >= window)
    documents = (
        rows.select("doc_id", "d1", "d2", "n_words", "whole")
        .join(known, ["d1", "d2"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("part", F.lit(0))).cast("long").alias("n_removed"),
            F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest", "whole")).alias("kept_sha256"),
        )
    )
    return {"documents": documents, "texts": cut}


def op7_substring(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))["documents"]


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, s, array_to_string(w[s:s + 34], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
again AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT rid, list(DISTINCT p) AS ps FROM (SELECT rid, unnest(range(s, s + 35)) AS p FROM win JOIN again USING (k)) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
              ELSE coalesce(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(ps, i)], ' '), '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (rid)
"""

QUERIES = {"op7_substring": op7_substring}
ORACLES = {"op7_substring": OP7_SQL}
