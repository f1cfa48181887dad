"""Hard negatives, positive-unlabelled quality and the filter audit."""

import math
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsight.llm import audit, negatives, pu_quality

SF = "/root/testdata/sf0.001"


def sql(query, **tables):
    c = duckdb.connect()
    for name, frame in tables.items():
        c.register(name, frame.toArrow()) if hasattr(frame, "toArrow") else c.execute(f"create view {name} as select * from '{frame}'")
    cursor = c.execute(query)
    names = [d[0] for d in cursor.description]
    return names, Counter(tuple(r[names.index(n)] for n in sorted(names)) for r in cursor.fetchall())


def result(frame):
    return sorted(frame.columns), Counter(tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect())


# ---- hard negatives ----

VECTORS = "vec_id long, embedding array<float>, label int, q int, block int, lane int, label_group int"


def mined_by_hand(rows, scale=256, positives=5, negatives_=5, floor=80):
    known = []
    for i, v, y, *_ in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known.append((i, [math.floor(scale * float(np.float32(x))) for x in v], y))
    out = []
    for a, v, y in known:
        if a % 100:
            continue
        scored = sorted(((sum(p * q for p, q in zip(v, w)), i, z) for i, w, z in known), key=lambda s: (-s[0], s[1]))
        for score, i, _ in [s for s in scored if s[2] == y and s[1] != a][:positives]:
            fits = [s for s in scored if s[2] != y and floor * score <= 100 * s[0] <= 100 * score][:negatives_]
            out += [(a, i, k, s[1], score, s[0]) for k, s in enumerate(fits, 1)]
    return Counter(out)


def vectors(kind, n=700):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        center = np.eye(8)[i % 5]
        v = center + 0.4 * rng.normal(size=8)
        if kind == "lengths":
            v = v * 10 ** rng.uniform(-2, 3)
        elif kind == "grid":
            v = np.round(v * 2) / 2  # many ties
        elif kind == "hot" and i % 3:
            v = np.full(8, 0.5)
        elif kind == "ragged":
            v = v[: rng.integers(0, 9)]
        rows.append((i, [float(x) for x in v], 1 if kind == "hot" and i % 3 else int(rng.integers(-3, 20 if kind == "grid" else 3)), 1, 2, 3, 4))
    return rows


EDGES = [
    (100, None, 1, 0, 0, 0, 0), (None, [1.0, 2.0], 1, 0, 0, 0, 0), (200, [1.0, None], 1, 0, 0, 0, 0), (300, [1.0, float("nan")], 1, 0, 0, 0, 0), (400, [float("inf"), 1.0], 1, 0, 0, 0, 0),
    (500, [1.0, 2.0], None, 0, 0, 0, 0), (600, [0.0, 0.0], 1, 0, 0, 0, 0), (700, [], 1, 0, 0, 0, 0), (1, [1.0, 2.0], 1, 0, 0, 0, 0), (1, [1.0, 2.0], 1, 0, 0, 0, 0), (2, [1.0, 1.9], 2, 0, 0, 0, 0),
    (2, [1.0, 1.9], 2, 0, 0, 0, 0), (0, [1.0, 2.0], 1, 0, 0, 0, 0), (0, [1.0, 2.0], 1, 0, 0, 0, 0), (800, [-1.0, -2.0], 1, 0, 0, 0, 0), (3, [0.0, 0.0], 3, 0, 0, 0, 0),
]


@pytest.mark.parametrize("kind", ["plain", "lengths", "grid", "hot", "ragged", "edges", "empty"])
def test_negatives_by_hand(spark, monkeypatch, kind):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "CELL_ANCHORS", 3)
    monkeypatch.setattr(negatives, "CELL_BLOCKS", 2)
    monkeypatch.setattr(negatives, "TASK_ROWS", 200)
    rows = {"edges": EDGES, "empty": []}.get(kind) if kind in ("edges", "empty") else vectors(kind)
    found = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 100 == 0)
    assert Counter(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == mined_by_hand(rows)


def test_lists_prune_and_lose_nothing():
    """Near an anchor the ranges leave few rows, and every row that reaches the score is among them."""
    rng = np.random.default_rng(1)
    v = np.floor(256 * (np.eye(8)[rng.integers(0, 8, 1000)] + 0.1 * rng.normal(size=(1000, 8)))).astype(np.int32)
    norms = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    lists = np.argsort(negatives._units(v, norms), axis=0, kind="stable").T.astype("<u2")
    block = negatives.Block(np.arange(1000), np.zeros(1000, np.int64), v, lists, float(norms.max()))
    left = []
    for k in range(50):
        anchor = negatives.Anchor(v[k].astype(np.int64))
        scores = v.astype(np.int64) @ v[k].astype(np.int64)
        for share in (0.5, 0.8, 1.0):
            least = share * scores.max()
            places = anchor.candidates(block, float(least))
            assert set(np.flatnonzero(scores >= least)) <= set(range(1000) if places is None else places)
            left.append(1000 if places is None else len(places))
    assert np.mean(left) < 400


def test_large_components_are_held(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 0.0], 1), (2, [3e29, 0.0], 2)]
    found = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 100 == 0)
    assert [tuple(r) for r in found.collect()] == [(0, 1, 1, 2, negatives.LIMIT**2, negatives.LIMIT**2)]


def test_negatives_against_sql(spark):
    names, expected = sql(negatives.OP11_SQL, embeddings=f"{SF}/embeddings.parquet")
    assert result(negatives.op11_hard_negatives(spark, SF)) == (sorted(names), expected)


# ---- quality from positives and unlabelled texts ----


def test_risk_slopes_by_small_steps():
    """One step down the risk follows the slope that small changes of each weight give."""
    rng = np.random.default_rng(3)
    rows = lambda n, shift: [np.flatnonzero(rng.random(6) < 0.4 + shift * (np.arange(6) < 3)) for _ in range(n)]
    p, u = rows(40, 0.3), rows(90, 0.0)
    for prior in (0.3, 0.6):
        w = pu_quality.fit_risk(p, u, prior, n=6, ridge=0.0, steps=2000, rate=0.05)
        total = lambda w: (lambda a, b: a + max(0.0, b))(*pu_quality.risk(pu_quality.values(p, w), pu_quality.values(u, w), prior))
        start = np.zeros(7)
        assert total(w) < total(start)
        for _ in range(20):
            assert total(w + rng.normal(size=7) * 0.02) > total(w) - 5e-3


def test_prior_is_found_from_unlabelled_texts():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.9):
        z_p, good = rng.normal(2, 1, 4000), rng.random(8000) < share
        z_u = np.where(good, rng.normal(2, 1, 8000), rng.normal(-3, 1, 8000))
        assert pu_quality.class_prior(z_p, z_u) == pytest.approx(share, abs=0.03)


def junk_corpus(seed=4, n=900):
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        words, good = list(rng.choice(plain, 60)), i % 5 != 0
        if not good:
            words = [w + ("###" if i % 2 else "!!").upper() for w in words] if i % 3 else words[:1] * 60
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_poor_texts_are_found_without_a_poor_label(spark):
    rows = junk_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y], "doc_id long, quality int")  # no document is labelled poor
    model = pu_quality.train(docs, labels)
    assert model.prior == pytest.approx(0.8, abs=0.08)
    new = junk_corpus(seed=9)
    scores = [r[0] for r in spark.createDataFrame([r[:2] for r in new], "doc_id long, text string").coalesce(1).transform(lambda d: d.select(pu_quality.quality_score(d, model))).collect()]
    assert sum((s >= 0.3) == bool(y) for s, (_, _, y) in zip(scores, new)) > 0.97 * len(new)


def test_pu_labels_that_contradict_are_not_trusted(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (None, 1), (3, None), (4, 0)], "doc_id long, quality int")
    assert [r[0] for r in pu_quality.sample_positives(labels).collect()] == [2]


@pytest.mark.parametrize("name", ["edge", "clashing", "empty"])
def test_pu_edges(request, spark, name):
    docs = request.getfixturevalue(name)
    for labels in ([], [(3, 1), (8, 1), (9, 0), (12, 1)]):
        model = pu_quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        scores = docs.select("text", pu_quality.quality_score(docs, model).alias("s")).collect()
        assert len(scores) == docs.count() and all(0 <= r.s <= 1 for r in scores)
        assert len({r.s for r in scores if not r.text}) <= 1


def test_features_of_a_long_text_do_not_depend_on_pieces(monkeypatch):
    raw = " ".join(f"w{i % 97}\n" if i % 11 == 0 else f"W{i % 5}" for i in range(20_000)).encode()
    whole = pu_quality.features(raw, {})
    monkeypatch.setattr(pu_quality, "PIECE", 1000)
    assert pu_quality.features(raw, {}) == whole
    counts = audit.term_counts(raw)
    monkeypatch.setattr(audit, "PIECE", 1000)
    assert audit.term_counts(raw) == counts


def test_pu_held_out_accuracy(spark):
    """On documents that training has not seen; the poor ones are never named as such."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = pu_quality.op12_pu_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    right = Counter((r.quality, r.predicted == r.quality) for r in scored)
    print("held out", right)
    assert right[1, True] > 0.93 * (right[1, True] + right[1, False]) and right[0, True] > 0.6 * (right[0, True] + right[0, False])


# ---- filter audit ----


def failed_by_hand(rows):
    words = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
    out = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        w = words(t)
        first = min((r[0] for r in rows if (r[1] or "") == t and r[0] is not None), default=None)
        fails = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), doc_id is not None and doc_id > first)
        out.append((doc_id, lang or "", len(w), len(set(w)), "".join(k for k, x in zip("ABCDE", fails) if x)))
    return out


def audit_by_hand(failed, labels):
    good, bad = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    out = Counter()
    for part in {r[1] for r in failed}:
        own = [(i, set(f)) for i, p, _, _, f in failed if p == part]
        gone = {f: 0 for f in "ABCDE"}
        rows = []
        for order in permutations("ABCDE"):
            before = set()
            for step, f in enumerate(order, 1):
                removed = [i for i, x in own if f in x and not x & before]
                gone[f] += len(removed)
                before = before | {f}
                rows.append((part, "".join(order), step, f, sum(not x & before for _, x in own), len(removed), sum(f in x and bool(x & (before - {f})) for _, x in own), sum(x == {f} for _, x in own), sum(i in good for i in removed), sum(i in bad for i in removed)))
        out.update((p, o, s, *rest, gone[f]) for p, o, s, f, *rest in rows)
    return out


@pytest.mark.parametrize("name", ["edge", "small", "clashing", "empty"])
def test_audit_by_hand(request, spark, name):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    failed = audit.failed_filters(docs.repartition(3), entries=300)
    by_hand = failed_by_hand(rows)
    assert Counter(map(tuple, failed.select("doc_id", "part", "n_words", "n_distinct", "failed").collect())) == Counter(by_hand)
    labels = [(1, 1, 0), (4, 0, 1), (4, None, 0), (5, 1, 1), (None, 1, 1), (8, 0, 0), (9, 1, None)]
    found = audit.interactions(failed, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert Counter(map(tuple, found.select(*columns).collect())) == audit_by_hand(by_hand, labels)


def test_matrix_by_hand(spark, small, monkeypatch):
    """The shards together hold how often each word of the dictionary occurs in each document, however many slots number the words."""
    monkeypatch.setattr(audit, "SLOT_WORDS", 100)
    docs = small.select("doc_id", F.lit("p").alias("part"), "text")
    matrix = audit.Matrix(docs.repartition(3), entries=300)
    word = {r.term: r.word for r in matrix.dictionary().collect()}
    assert sorted(word) == list(range(len(word)))
    found = {}
    for r in matrix.csr().collect():
        starts, terms, counts = (np.frombuffer(bytes(r[c]), k) for c, k in (("starts", "<i8"), ("terms", "<i8"), ("counts", "<u4")))
        for doc_id, a, b in zip(r.doc_ids, starts, starts[1:]):
            assert list(terms[a:b]) == sorted(terms[a:b])
            found[doc_id] = Counter({word[t]: int(c) for t, c in zip(terms[a:b], counts[a:b])})
    assert found == {r.doc_id: Counter((r.text or "").split()) for r in docs.collect()}


def test_audit_against_sql(spark):
    names, expected = sql(audit.OP13_SQL, documents=f"{SF}/documents.parquet", labels=f"{SF}/labels.parquet")
    assert result(audit.op13_filter_audit(spark, SF)) == (sorted(names), expected)
