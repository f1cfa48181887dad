"""Quality rules: a linear-chain conditional random field labels each line content or boilerplate.

A line's features are a handful of yes/no signs of the line itself. The labels that the field is fitted on come from elsewhere: the
quality label of its document, and where else the line occurs. In a document of high quality a line is content, unless the same
line has `LONG_LINE` words or more and stands between `LEAST_CONTEXTS` different pairs of lines in two sources or more, counted over all
documents: so do notices, but not the lines of near copies, nor short phrases that recur by chance. In a document of low quality a line is boilerplate, unless it is also a line of a sampled document of high
quality. The field is fitted on a bounded sample: `max_rows` labelled documents by hash of doc_id, so that both qualities have
their natural share, and of those `max_segments` stretches of `SEGMENT` lines. Viterbi decoding labels
the lines of every document, and the share of its words that stand in content lines decides.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged, table

MAX_ROWS = 4_000
MAX_SEGMENTS = 20_000
SEGMENT = 64
LEAST_CONTEXTS = 8
LONG_LINE = 10
LINE_SEED = 42  # that of Spark's xxhash64
SYMBOLS = b"#*$%&|<>"
#: Words of licence, navigation and notice lines.
NOTICES = frozenset(
    b"licensed license licence rights reserved copyright cookies cookie privacy terms subscribe login javascript"
    b" lizenziert lizenz rechte licencia derechos licence droits".split()
)
SIGNS = (
    "symbols in a twentieth of the characters", "symbols in a fifth", "a tenth of words are bars", "a third of words shout",
    "most words upper case", "a fifth of words follow themselves", "under half of the words differ", "equals an earlier line",
    "notice words", "under 3 words", "3 to 9 words", "ends a sentence", "many digits", "words over 14 letters on average",
    "first of the text",
)


def line_signs(line: bytes, words: list[bytes], repeated: bool, first: bool) -> int:
    """The signs of a line as bits, in the order of SIGNS."""
    n, chars = len(words), sum(map(len, words))
    symbols = sum(line.count(c) for c in SYMBOLS)
    found = (
        20 * symbols > chars, 5 * symbols > chars, 10 * words.count(b"|") > n, 3 * sum(w.endswith(b"!!") for w in words) > n,
        n > 2 and 2 * sum(w.isupper() for w in words) > n, 5 * sum(a == b for a, b in zip(words, words[1:])) > n,
        n > 9 and 2 * len(set(words)) < n, repeated,
        n < 30 and any(w.strip(b".,:;").lower() in NOTICES for w in words), n < 3, 3 <= n < 10, words[-1][-1:] in b".!?", 4 * sum(c in b"0123456789" for c in line) > chars, chars > 14 * n, first,
    )
    return sum(1 << k for k, yes in enumerate(found) if yes)


def signs_of(raw: bytes) -> tuple[list[int], list[int], int]:
    """Of the lines that have a word: signs, numbers of words; and how many equal an earlier line."""
    signs, sizes, seen = [], [], set()
    for line in raw.split(b"\n"):
        if words := line.split():
            signs.append(line_signs(line, words, line in seen, not seen))
            sizes.append(len(words))
            seen.add(line)
    return signs, sizes, len(signs) - len(seen)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words in windows of `width` (a power of two) words that occur twice or more in the text."""
    ids: dict[bytes, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(ids) == len(at) or len(at) <= width:
        return 0
    span = 1
    while span < width:  # numbers for runs of twice the length, equal only for equal runs
        _, at = np.unique(at[:-span] * (int(at.max()) + 1) + at[span:], return_inverse=True)
        span *= 2
    again = np.bincount(at)[at] > 1
    edge = np.zeros(len(words) + 1, np.int32)
    edge[: len(again)] += again
    edge[width : width + len(again)] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


@dataclass(frozen=True)
class Field:
    """State 1 is content. unary: weight of each sign for content, bias last; pair[a, b]: from a to b."""

    unary: np.ndarray
    pair: np.ndarray


NO_LABELS = Field(np.append(np.zeros(len(SIGNS)), 1.0), np.zeros((2, 2)))


def _bits(signs: np.ndarray) -> np.ndarray:
    return np.concatenate([signs[..., None] >> np.arange(len(SIGNS)) & 1, np.ones((*signs.shape, 1), np.int64)], axis=-1).astype(float)


def fit_field(lines: list[list[tuple[int, int]]], *, ridge: float = 1e-4, steps: int = 200, close: float = 1e-5) -> Field:
    """Maximum likelihood, with a small ridge, of sequences of (signs, state), by forward and backward sums and BFGS steps.

    Equal stretches are summed once. Steps end when no slope is above `close`, or after `steps`.
    """
    counted = Counter(tuple(s[k : k + SEGMENT]) for s in lines for k in range(0, len(s), SEGMENT))
    if len({y for s in counted for _, y in s}) < 2:
        return NO_LABELS
    by_size: dict[int, list[tuple]] = defaultdict(list)
    for s in sorted(counted):
        by_size[1 << (len(s) - 1).bit_length()].append(s)
    groups = []
    for width, parts in by_size.items():
        size = np.array([len(s) for s in parts])
        signs, y = (np.zeros((len(parts), width), np.int64) for _ in range(2))
        for i, s in enumerate(parts):
            signs[i, : len(s)], y[i, : len(s)] = zip(*s)
        groups.append((_bits(signs), y, np.arange(width) < size[:, None], np.array([counted[s] for s in parts], float)))
    n = sum(len(s) * k for s, k in counted.items())

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        sums = [_likelihood(*g, w[:-4], w[-4:].reshape(2, 2)) for g in groups]
        value = -sum(v for v, _, _ in sums) / n + ridge / 2 * (w @ w)
        return value, -np.append(sum(u for _, u, _ in sums), sum(p for _, _, p in sums)) / n + ridge * w

    w, near = np.zeros(len(SIGNS) + 5), np.eye(len(SIGNS) + 5)
    value, slope = loss(w)
    for _ in range(steps):
        if np.abs(slope).max() < close:
            break
        step = -near @ slope
        while True:
            new, new_slope = loss(w + step)
            if new <= value + 1e-4 * (slope @ step) or np.abs(step).max() < 1e-9:
                break
            step = step / 2
        turn = new_slope - slope
        if step @ turn > 1e-12:
            left = np.eye(len(w)) - np.outer(step, turn) / (step @ turn)
            near = left @ near @ left.T + np.outer(step, step) / (step @ turn)
        w, value, slope = w + step, new, new_slope
    return Field(w[:-4], w[-4:].reshape(2, 2))


def _likelihood(x: np.ndarray, y: np.ndarray, here: np.ndarray, weight: np.ndarray, u: np.ndarray, pair: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log likelihood of one batch of stretches, and its slopes by the unary and the pair weights."""
    both = here[:, 1:]
    on = np.stack([np.zeros(here.shape), x @ u], axis=-1) * here[..., None]
    ahead, back = np.zeros_like(on), np.zeros_like(on)
    ahead[:, 0] = on[:, 0]
    for t in range(1, on.shape[1]):
        step = np.logaddexp(ahead[:, t - 1, :1] + pair[0], ahead[:, t - 1, 1:] + pair[1]) + on[:, t]
        ahead[:, t] = np.where(here[:, t, None], step, ahead[:, t - 1])
    for t in range(on.shape[1] - 2, -1, -1):
        nxt = on[:, t + 1] + back[:, t + 1]
        step = np.logaddexp(pair[:, 0] + nxt[:, :1], pair[:, 1] + nxt[:, 1:])
        back[:, t] = np.where(here[:, t + 1, None], step, 0.0)
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    p = np.exp(ahead + back - total[:, None, None])[..., 1] * here
    joint = ahead[:, :-1, :, None] + pair + (on + back)[:, 1:, None, :] - total[:, None, None, None]
    expected = np.einsum("itab,it,i->ab", np.exp(np.minimum(joint, 0)), both, weight)
    seen = np.array([[(((y[:, :-1] == a) & (y[:, 1:] == b) & both) * weight[:, None]).sum() for b in (0, 1)] for a in (0, 1)])
    value = ((on[..., 1] * y).sum(axis=1) - total) @ weight + (seen * pair).sum()
    return value, np.einsum("ij,ijk,i->k", (y - p) * here, x, weight), seen - expected


def viterbi(signs: list[int], unary: np.ndarray, pair: np.ndarray) -> list[bool]:
    """The likeliest labels of a text's lines; True is content."""
    if not signs:
        return []
    on = (_bits(np.array(signs)) @ unary).tolist()
    (p00, p01), (p10, p11) = pair.tolist()
    low, high, back = 0.0, on[0], []
    for s in on[1:]:
        from0, from1 = low + p00 < high + p10, low + p01 < high + p11
        low, high = max(low + p00, high + p10), max(low + p01, high + p11) + s
        back.append((from0, from1))
    states = [high >= low]
    for step in reversed(back):
        states.append(step[states[-1]])
    return states[::-1]


def recurring_lines(docs: DataFrame, lines: DataFrame, *, least_contexts: int = LEAST_CONTEXTS, least_sources: int = 2) -> DataFrame:
    """line (its hash) of those in `lines` that stand between `least_contexts` different pairs of lines, in `least_sources` sources of `docs`."""
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    hashes = F.transform(F.split("text", "\n", -1), lambda x: F.xxhash64(x))
    rows = docs.select(hashes.alias("lines"), F.coalesce(source, F.lit("")).alias("source"))
    each = F.transform("lines", lambda x, i: F.struct(x.alias("line"), F.xxhash64(F.when(i > 0, F.get("lines", i - 1)), F.get("lines", i + 1)).alias("context")))
    every = rows.select("source", F.inline(F.array_distinct(each)))
    counted = every.join(lines, "line", "left_semi").groupBy("line").agg(F.countDistinct("context").alias("contexts"), F.countDistinct("source").alias("sources"))
    return counted.where((F.col("contexts") >= least_contexts) & (F.col("sources") >= least_sources)).select("line")


def labelled_lines(docs: DataFrame, ids: DataFrame, *, max_segments: int = MAX_SEGMENTS) -> list[list[tuple[int, int]]]:
    """Stretches of (signs, state) of the documents in `ids` (doc_id, quality; few), at most `max_segments` of SEGMENT lines by hash."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            quality, signs, hashes, sizes = [], [], [], []
            for q, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                raw = raw or b""
                found, n_words, _ = signs_of(raw)
                named = [xxhash.xxh64_intdigest(x, LINE_SEED) for x in raw.split(b"\n") if x.split()]
                for k in range(0, len(found), SEGMENT):
                    quality.append(q), signs.append(found[k : k + SEGMENT]), sizes.append(n_words[k : k + SEGMENT])
                    hashes.append(np.array(named[k : k + SEGMENT], np.uint64).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(quality, pa.int32()), pa.array(signs, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], names=["quality", "signs", "lines", "sizes"])

    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.col("quality").cast("int").alias("quality"), "text")
    parts = rows.mapInArrow(lines, "quality int, signs array<int>, lines array<long>, sizes array<int>")
    parts = staged(parts.orderBy(F.xxhash64("signs", "lines", "quality")).limit(max_segments), "segments")
    names = parts.select(F.inline(F.arrays_zip(F.col("lines").alias("line"), "sizes"))).where(F.col("sizes") >= LONG_LINE).select("line").distinct()
    elsewhere = {r[0] for r in recurring_lines(docs, names).collect()}  # some of the lines of `max_segments` stretches
    sample = sorted(tuple(r) for r in parts.select("quality", "signs", "lines").collect())
    good = {x for q, _, lines in sample if q == 1 for x in lines}
    state = lambda q, x: int(x not in elsewhere if q == 1 else x in good and x not in elsewhere)
    return [[(s, state(q, x)) for s, x in zip(signs, lines)] for q, signs, lines in sample]


def sample_quality(labels: DataFrame, *, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, quality: at most `max_rows` labelled documents, by hash of doc_id. A doc_id with both labels has none."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    known = known.where("quality = _most").withColumn("_h", F.xxhash64(F.lit("lines"), "doc_id"))
    return known.orderBy("_h", "doc_id").limit(max_rows).select("doc_id", "quality")


def train_field(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS) -> Field:
    """Fit on at most `max_rows` documents with a quality label; without both labels every line is content."""
    return fit_field(labelled_lines(docs, sample_quality(labels, max_rows=max_rows)))


OUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long, labels array<boolean>"
)


def judge(docs: DataFrame, field: Field, *, least_words: int = 20, most_repeat: int = 30, least_content: float = 0.5) -> DataFrame:
    """Counts, labels of the lines with a word, and the verdict for every row of `docs` (doc_id, text; others unused).

    base_failed: under `least_words` words, or over `most_repeat` percent of them in repeated 8-word windows. kept: not base_failed
    and at least `least_content` of the words in content lines. Null and empty texts have no words, so they fail.
    Repeated rows get equal results; an empty table gives none.
    """
    unary, pair = field.unary, field.pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                raw = raw or b""
                words = raw.split()
                signs, sizes, dups = signs_of(raw)
                labels = viterbi(signs, unary, pair)
                again, n = repeated_words(words), len(words)
                content = sum(s for s, yes in zip(sizes, labels) if yes)
                failed = n < least_words or 100 * again > most_repeat * n
                chars = len(b"".join(words).decode())
                symbols = sum(raw.count(c) for c in SYMBOLS)
                rows.append((n, chars, symbols, dups, again, failed, not failed and content >= least_content * n, content, labels))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.list_(pa.bool_())]
            names = [c.split()[0] for c in OUT.split(", ")]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", *names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {OUT}")


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train_field(docs, table(spark, sf_dir, "labels"))).drop("labels")


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
