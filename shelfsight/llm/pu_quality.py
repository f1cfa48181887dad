"""Quality from positives and unlabelled texts: non-negative unbiased risk with an estimated class prior.

The trusted positives are documents labelled good; the unlabelled ones are documents as they come, whatever their labels. With z the classifier, pi the
share of good documents among the unlabelled and l(z) = 1 / (1 + exp(z)), the risk is pi * mean_P l(z) + max(0, mean_U l(-z) - pi * mean_P l(-z)): what the unlabelled
texts would cost as negatives, less what the good ones among them account for. Where that difference turns negative, which only overfitting makes it,
steps go up in it instead of down. The loss is bounded: where most texts are good, the noise of an unbounded one in the two means outweighs what the few
poor texts add, and they are never learnt.

The prior is not given: a first classifier only tells positives from unlabelled texts, and on a part of the sample that it has not seen, the prior is the smallest
ratio of unlabelled to positive texts above any score, each share with its margin of error.

Features are yes/no: ranges of shares in a text (symbols, capitals, repeated words and lines, ...), and which shapes its words have and how often. Words
themselves are none: with few thousand positives they are learnt by heart, which hides the poor texts behind the clip above. The model is fitted on a bounded sample by hash of doc_id, `max_rows` of each kind; scoring reads every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .base import staged, table
from .toxicity import held_out

MAX_ROWS = 10_000
SLICE = 64
PIECE = 1 << 20
SYMBOLS = b"#*$%&|<>{}[]\\^~_="
#: Ends of the ranges that a share is put in.
RANGES = (0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
STATS = (
    "symbols", "capitals", "digits", "marks", "other scripts", "word length / 20", "log2 of words / 20", "different words", "commonest word", "words that follow themselves",
    "loud words", "bars", "lines that recur", "log2 of words a line / 20", "words once only",
)
SHAPES = 1 << 10
SHAPE_LEVELS = (0.0, 0.05, 0.3)
N_FEATURES = len(STATS) * (len(RANGES) + 1) + SHAPES * len(SHAPE_LEVELS)
_KIND = bytearray(b"." * 256)
for _b in range(256):
    c = chr(_b)
    _KIND[_b] = ord("A" if c.isascii() and c.isupper() else "a" if c.isascii() and c.islower() or _b >= 0x80 else "0" if c.isascii() and c.isdigit() else c if _b > 0x20 and _b < 0x7F else ".")
_KIND = bytes(_KIND)
_RUN = re.compile(rb"(.)\1+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ALL = bytes(range(256))
_drop = lambda keep: _ALL.translate(None, keep)
_CAPITALS, _DIGITS, _LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS, _WIDE = b".,;:!?'\"()-", bytes(range(0x80, 0x100))
_NOT = {k: _drop(v) for k, v in {"symbols": SYMBOLS, "capitals": _CAPITALS, "digits": _DIGITS, "letters": _LETTERS, "marks": _MARKS, "wide": _WIDE}.items()}


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, of a very long one about a million bytes at a time."""
    at = 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + PIECE) if len(raw) - at > PIECE else None
        end = gap.end() if gap else len(raw)
        yield raw[at:end].split()
        at = end


def features(raw: bytes, shapes: dict[bytes, int]) -> list[int]:
    """Numbers of the features that a text has, in order. `shapes` remembers those of kinds of words."""
    counts: Counter = Counter()
    n = same = 0
    last = None
    for words in pieces(raw):
        if words:
            counts.update(words)
            same += (words[0] == last) + sum(a == b for a, b in zip(words, words[1:]))
            n, last = n + len(words), words[-1]
    size = lambda k: len(raw.translate(None, _NOT[k]))
    chars, letters = max(1, sum(len(w) * k for w, k in counts.items())), size("letters")
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    shaped: Counter = Counter()
    for word, k in counts.items():
        kind = word.translate(_KIND)
        shape = shapes.get(kind)
        if shape is None:
            shape = zlib.crc32(_RUN.sub(rb"\1", kind)) % SHAPES
            if len(shapes) < 1 << 16:
                shapes[kind] = shape
        shaped[shape] += k
    whole = max(1, n)
    values = (
        size("symbols") / chars, size("capitals") / max(1, letters), size("digits") / chars, size("marks") / chars, size("wide") / chars,
        chars / whole / 20, whole.bit_length() / 20, len(counts) / whole, max(counts.values(), default=0) / whole, same / whole,
        raw.count(b"!!") / whole, raw.count(b"|") / whole, 1 - len(set(lines)) / max(1, len(lines)), (whole // max(1, len(lines)) + 1).bit_length() / 20,
        sum(k == 1 for k in counts.values()) / whole,
    )
    width = len(RANGES) + 1
    found = [k * width + int(np.searchsorted(RANGES, v)) for k, v in enumerate(values)]
    at = len(STATS) * width
    found += [at + SHAPES * level + s for s, k in shaped.items() for level, least in enumerate(SHAPE_LEVELS) if k > least * whole]
    return sorted(found)


@dataclass(frozen=True)
class Model:
    """prior: the estimated share of good documents among the unlabelled ones."""

    bias: float
    weights: np.ndarray
    prior: float


def flat(rows: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every entry."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return at, np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk: of the positives as such, and of the unlabelled as negatives less the positives among them."""
    p, u = _sigmoid(z_p).mean(), _sigmoid(z_u).mean()
    return float(prior * (1 - p)), float(u - prior * p)


def fit_risk(positive: Sequence[np.ndarray], unlabelled: Sequence[np.ndarray], prior: float | None, *, n: int = N_FEATURES, ridge: float = 3e-5, steps: int = 300, rate: float = 0.03) -> np.ndarray:
    """Weights (n features, bias last) that minimise the non-negative risk and ridge |w|^2, by Adam steps over all rows.

    Without a prior: a logistic classifier of positives against unlabelled texts, both kinds weighing alike."""
    (at_p, col_p), (at_u, col_u) = flat(positive), flat(unlabelled)
    w, m, v = (np.zeros(n + 1) for _ in range(3))
    for t in range(1, steps + 1):
        p = _sigmoid(np.bincount(at_p, w[col_p], len(positive)) + w[n])
        u = _sigmoid(np.bincount(at_u, w[col_u], len(unlabelled)) + w[n])
        if prior is None:
            d_p, d_u = (p - 1) / len(p) / 2, u / len(u) / 2
        else:
            d_p, d_u = prior * p * (1 - p) / len(p), u * (1 - u) / len(u)
            d_p, d_u = (-2 * d_p, d_u) if u.mean() >= prior * p.mean() else (d_p, -d_u)
        g = np.append(np.bincount(col_p, d_p[at_p], n) + np.bincount(col_u, d_u[at_u], n), d_p.sum() + d_u.sum())
        g[:n] += 2 * ridge * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * min(1.0, 3 * (1 - t / (steps + 1))) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def values(rows: Sequence[np.ndarray], w: np.ndarray) -> np.ndarray:
    at, col = flat(rows)
    return np.bincount(at, w[col], len(rows)) + w[-1]


def class_prior(z_p: np.ndarray, z_u: np.ndarray, *, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled: the smallest ratio, over all scores, of unlabelled to positive texts above.

    Which score is chosen depends on the ratio with its margin of error at `doubt`, so that the few highest ones do not decide."""
    cuts = np.unique(z_p)
    above = lambda z: 1 - np.searchsorted(np.sort(z), cuts) / len(z)
    q_p, q_u = above(z_p), above(z_u)
    margin = np.sqrt(np.log(4 / doubt) / 2 / len(z_u)) + np.sqrt(np.log(4 / doubt) / 2 / len(z_p))
    best = int(np.argmin((q_u + margin) / q_p))
    return float(np.clip(q_u[best] / q_p[best], 0.01, 0.99))


def fit(positive: Sequence[np.ndarray], unlabelled: Sequence[np.ndarray]) -> Model:
    """A model from the features of positives and unlabelled texts. Without positives every text is as likely good as not, without unlabelled ones good."""
    if not len(positive) or not len(unlabelled):
        return Model(3.0 if len(positive) else 0.0, np.zeros(N_FEATURES), 0.99 if len(positive) else 0.5)
    half = lambda rows, k: rows[k::2] if len(rows) > 1 else rows
    first = fit_risk(half(positive, 0), half(unlabelled, 0), None)
    prior = class_prior(values(half(positive, 1), first), values(half(unlabelled, 1), first))
    w = fit_risk(positive, unlabelled, prior)
    return Model(float(w[-1]), w[:-1], prior)


def sample_positives(labels: DataFrame, *, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id of at most `max_rows` documents labelled good, by hash of doc_id; one that is labelled both ways is not trusted."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most"))
    good = good.where("least = 1 and most = 1").withColumn("_h", F.xxhash64(F.lit("positive"), "doc_id"))
    return good.orderBy("_h", "doc_id").limit(max_rows).select("doc_id")


def sample_unlabelled(docs: DataFrame, *, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id of at most `max_rows` documents, by hash of doc_id."""
    every = docs.where("doc_id is not null").select("doc_id", F.xxhash64(F.lit("unlabelled"), "doc_id").alias("_h"))
    return every.orderBy("_h", "doc_id").limit(max_rows).select("doc_id")


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS) -> Model:
    """Fit on documents (doc_id, text) that are not held out: `max_rows` labelled good, and `max_rows` of all, whose labels are not looked at.

    Both lists of doc_ids are broadcast; the driver gets the features of their texts, four bytes each."""
    open_ = docs.where(~held_out(F.col("doc_id")))
    good, some = sample_positives(labels.where(~held_out(F.col("doc_id"))), max_rows=max_rows), sample_unlabelled(open_, max_rows=max_rows)
    kinds = good.withColumn("kind", F.lit(1)).unionByName(some.withColumn("kind", F.lit(0)))
    marked = kinds.groupBy("doc_id").agg(F.max("kind").alias("good"), F.min("kind").alias("not_some"))
    texts = staged(open_.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("doc_id", "good", "not_some", "text"), "pu-sample")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes: dict[bytes, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                active = [np.array(features(t or b"", shapes), "<u4").tobytes() for t in part.column(3).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1), part.column(2), pa.array(active, pa.binary())], names=["doc_id", "good", "not_some", "active"])

    got = texts.mapInArrow(encoded, "doc_id string, good int, not_some int, active binary").toLocalIterator()
    rows = sorted((r["doc_id"], bytes(r["active"]), r["good"], r["not_some"]) for r in got)
    active = [np.frombuffer(a, "<u4") for _, a, _, _ in rows]
    return fit([a for a, r in zip(active, rows) if r[2] == 1], [a for a, r in zip(active, rows) if r[3] == 0])


def quality_score(docs: DataFrame, model: Model) -> Column:
    """A column of scores for `docs.text`, 0 to 1; a null text scores as an empty one."""
    bias, weights = model.bias, model.weights.astype(np.float64)

    @F.arrow_udf(DoubleType())
    def scores(text: pa.Array) -> pa.Array:
        found, shapes = np.zeros(len(text)), {}
        for at in range(0, len(text), SLICE):  # few texts at a time are Python objects
            part = text.slice(at, SLICE).cast(pa.binary()).to_pylist()
            found[at : at + len(part)] = [bias + float(weights[features(t or b"", shapes)].sum()) for t in part]
        return pa.array(_sigmoid(found))

    return scores(docs["text"])


def op12_pu_quality(spark, sf_dir):
    """doc_id, held_out, score, predicted for every row of documents.

    Null and empty texts have one score, repeated rows equal ones; a null doc_id is not held out and never trained on. An
    empty table gives no rows, other columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {"op12_pu_quality": op12_pu_quality}
ORACLES: dict[str, str] = {}
