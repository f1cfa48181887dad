"""Toxicity: a counterfactual-regularised linear classifier.

A document's features are its distinct lower-case words and their beginnings of 4 to 6 letters, each
present or absent. Document frequencies by label choose the features, and identity terms are always among them; a logistic
model is fitted on them with a penalty on the squared change of its score when identity terms of a labelled text are swapped
for other terms of their kind. A labelled text without such a term gets its counterfactual by putting one in, a term chosen by the
hash of its words: the pair is "as it is" and "with a group mention", for both labels alike. So a group mention that
happens to occur with label 1 gains no weight unless the rest of the text carries it.

The model is fitted on a bounded sample, `max_rows` labelled rows of each class by hash of doc_id;
scoring reads every whole text.
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

MAX_ROWS = 10_000
MAX_FEATURES = 8192
MIN_DOCS = 4
PREFIXES = (4, 5, 6)
SLICE = 256
#: Identity terms by kind; a term is swapped for the next of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man", "trans", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_TOKEN = re.compile(r"[^\W_]+")


def features(words: set[str]) -> set[str]:
    """Words and, marked by a star, beginnings of words."""
    found = set(words)
    for n in PREFIXES:
        found |= {w[:n] + "*" for w in words if len(w) >= n}
    return found


def words_of(text: str) -> set[str]:
    return set(_TOKEN.findall(text.lower()))


def swapped(words: set[str], kinds=IDENTITY_TERMS) -> set[str]:
    """The words with every identity term replaced by the next of its kind."""
    turn = {t: kind[(k + 1) % len(kind)] for kind in kinds for k, t in enumerate(kind)}
    return {turn.get(w, w) for w in words}


def counterfactual(words: set[str], kinds=IDENTITY_TERMS) -> set[str]:
    """The words after the swap; where there is no identity term, with one put in, chosen by the words' hash."""
    other = swapped(words, kinds)
    terms = [t for kind in kinds for t in kind]
    if other != words or not terms:
        return other
    return words | {terms[zlib.crc32(" ".join(sorted(words)).encode()) % len(terms)]}


@dataclass(frozen=True)
class Model:
    """swaps: labelled texts whose counterfactual has other features, so that the penalty reads them."""

    bias: float
    weights: dict[str, float]
    swaps: int = 0


def score(text: str, bias: float, weights: dict[str, float]) -> float:
    z = bias + sum(weights[f] for f in sorted(weights.keys() & features(words_of(text))))
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def fit_weights(rows: list[tuple[int, Sequence[int], Sequence[int]]], n: int, *, ridge: float = 2.0, penalty: float = 4.0, steps: int = 400) -> np.ndarray:
    """Weights (n features, bias last) of (label, active, active after the swap) rows, classes weighing alike.

    Minimises mean log loss + ridge |w|^2 / rows + penalty * mean (z(x) - z(swapped x))^2 by
    gradient descent with a step scaled per feature.
    """
    y = np.array([r[0] for r in rows], float)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    if not 0 < y.sum() < len(y):
        w = np.zeros(n + 1)
        w[n] = 0.0 if not len(y) else (3.0 if y.all() else -3.0)
        return w
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[1]) for r in rows])
    col = np.concatenate([np.asarray(r[1], np.int32) for r in rows])
    d_at, d_col, d_sign = [], [], []
    for i, (_, now, then) in enumerate(rows):
        if then is now:
            continue
        now, then = list(map(int, now)), list(map(int, then))
        for c, s in [(c, 1.0) for c in set(now) - set(then)] + [(c, -1.0) for c in set(then) - set(now)]:
            d_at.append(i), d_col.append(c), d_sign.append(s)
    d_at, d_col, d_sign = np.array(d_at, np.int64), np.array(d_col, np.int64), np.array(d_sign)
    scale = np.bincount(col, share[at] * 0.25, n) + 2 * ridge / len(y)
    if len(d_at):
        scale += 2 * penalty * np.bincount(d_col, share[d_at], n)
    scale = np.append(scale, 0.25)
    w, speed = np.zeros(n + 1), np.zeros(n + 1)
    rate = 1.0 / max(1.0, np.percentile(np.bincount(at, minlength=len(y)), 90))
    for _ in range(steps):
        z = np.bincount(at, w[col], len(y)) + w[n]
        off = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.append(np.bincount(col, off[at], n) + 2 * ridge / len(y) * w[:n], off.sum())
        if len(d_at):
            dz = np.bincount(d_at, d_sign * w[d_col], len(y))
            g[:n] += 2 * penalty * np.bincount(d_col, d_sign * (share * dz)[d_at], n)
        speed = 0.9 * speed - rate * g / scale
        w += speed
    return w


def fit(labelled: DataFrame, *, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS, kinds=IDENTITY_TERMS, penalty: float = 4.0) -> Model:
    """A model from (text, toxic) rows; rows with a null label are left out, a null text is empty.

    `labelled` has at most 2 * max_rows rows (see `sample_labels`). Feature counts are made by Spark;
    the driver gets the `max_features` chosen features and the numbers of the active ones in each row.
    """
    # the sample is read three times, the documents that it is taken from once
    rows = staged(labelled.where("toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic")), "labelled")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y].update(features(words_of(text or "")))
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict({"feature": names, "n0": [seen[0][f] for f in names], "n1": [seen[1][f] for f in names]})

    totals = rows.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    t0, t1 = (float(x or 0) for x in totals)
    counts = rows.mapInArrow(counted, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # how far the shares among the two classes lie apart, in standard errors
    p0, p1 = F.col("n0") / max(1.0, t0), F.col("n1") / max(1.0, t1)
    p = (F.col("n0") + F.col("n1") + 1) / (t0 + t1 + 2)
    apart = F.abs(p1 - p0) / F.sqrt(p * (1 - p) * (1 / max(1.0, t0) + 1 / max(1.0, t1)))
    chosen = counts.where((F.col("n0") + F.col("n1") >= min_docs) & (apart > 3)).orderBy(apart.desc(), "feature").limit(max_features)
    terms = features({t for kind in kinds for t in kind})
    names = sorted({r[0] for r in chosen.select("feature").collect()} | terms)
    place = {f: i for i, f in enumerate(names)}
    number = np.uint16 if len(names) <= 1 << 16 else np.uint32

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic, now, then = [], [], []
            active = lambda w: np.array(sorted(place[f] for f in place.keys() & features(w)), number).tobytes()
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text or "")
                toxic.append(y)
                now.append(active(words))
                other = active(counterfactual(words, kinds))
                then.append(None if other == now[-1] else other)
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int64()), pa.array(now, pa.binary()), pa.array(then, pa.binary())], names=["toxic", "now", "then"])

    # two bytes a feature, or four beyond 65,536 features: a bounded sample stays small on the driver
    taken = sorted((r[0], bytes(r[1]), bytes(r[2] or b""), r[2] is not None) for r in rows.mapInArrow(encoded, "toxic long, now binary, then binary").toLocalIterator())
    data = []
    for y, now, then, differs in taken:
        active = np.frombuffer(now, number)
        data.append((y, active, np.frombuffer(then, number) if differs else active))
    w = fit_weights(data, len(names), penalty=penalty)
    return Model(float(w[-1]), {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-4}, sum(differs for *_, differs in taken))


def sample_labels(labels: DataFrame, *, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most `max_rows` labelled doc_ids of each class, by hash of doc_id. A doc_id with both labels has none."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
    known = known.where("toxic = _most").drop("_most")
    by_hash = known.withColumn("_h", F.xxhash64(F.lit("labels"), "doc_id"))
    parts = [by_hash.where(F.col("toxic") == y).orderBy("_h", "doc_id").limit(max_rows) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).drop("_h")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, penalty: float = 4.0) -> Model:
    """Fit on labelled documents that are not held out. The sampled labels, 2 * max_rows at most, are broadcast.

    Without both labels every text gets the one score of the label that is there, or 0.5."""
    ids = sample_labels(labels.where(~held_out(F.col("doc_id"))), max_rows=max_rows)
    return fit(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic"), penalty=penalty)


def toxicity_score(docs: DataFrame, model: Model) -> Column:
    """A column of scores for `docs.text`, 0 to 1; a null text scores as an empty one."""
    bias, weights = model.bias, model.weights  # max_features weights at most travel with the task

    @F.arrow_udf(DoubleType())
    def scores(text: pa.Array) -> pa.Array:
        found = np.zeros(len(text))
        for at in range(0, len(text), SLICE):  # few texts at a time are Python objects
            found[at : at + SLICE] = [score(t or "", bias, weights) for t in text.slice(at, SLICE).to_pylist()]
        return pa.array(found)

    return scores(docs["text"])


def drop_toxic(docs: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `threshold`, same columns."""
    return docs.where(toxicity_score(docs, model) < threshold)


def op6_toxicity(spark, sf_dir):
    """doc_id, held_out, score, predicted for every row of documents; a null doc_id is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
