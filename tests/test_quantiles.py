"""Exact quantiles by bracket and refine, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsight.operators import quantiles as Q

SHARES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def frame_of(spark, kind):
    rng = np.random.default_rng(len(kind))
    if kind == "skewed":  # nine tenths in one group
        keys = np.where(rng.random(20_000) < 0.9, 1, rng.integers(2, 40, 20_000)).tolist()
        values = rng.lognormal(0, 3, 20_000).tolist()
    elif kind == "ties":
        keys, values = rng.integers(0, 5, 5_000).tolist(), np.where(rng.random(5_000) < 0.7, 3.0, rng.integers(0, 9, 5_000)).tolist()
    elif kind == "small":  # groups of 1 to 7 values
        keys = [k for k in range(60) for _ in range(k % 7 + 1)]
        values = rng.normal(size=len(keys)).tolist()
    else:  # nulls, NaN, infinities and groups without a value
        keys = [None if k % 11 == 0 else k % 6 for k in range(600)]
        values = [None if k % 6 == 2 or k % 5 == 0 else float("nan") if k % 7 == 0 else float("inf") if k % 13 == 0 else -float(k) for k in range(600)]
    return spark.createDataFrame(list(zip(keys, values)), "k int, x double"), list(zip(keys, values))


def by_hand(rows):
    groups = {}
    for k, x in rows:
        groups.setdefault(k, []).append(x)
    out = {}
    for k, xs in groups.items():
        known = np.sort([x for x in xs if x is not None and x == x])
        places = [p * (len(known) - 1) for p in SHARES]
        at = lambda i: known[int(np.floor(i))] if known[int(np.floor(i))] == known[int(np.ceil(i))] else (1 - i % 1) * known[int(np.floor(i))] + i % 1 * known[int(np.ceil(i))]
        out[k] = (len(xs), len(known), [at(i) if len(known) else None for i in places])
    return out


@pytest.mark.parametrize("kind", ["skewed", "ties", "small", "nulls"])
@pytest.mark.parametrize("most", [Q.MOST, 40])
def test_groups_by_hand(spark, monkeypatch, kind, most):
    """The same with brackets that are narrowed round by round; no bracket is then left wider than its bound, but for equal values."""
    monkeypatch.setattr(Q, "MOST", most)
    monkeypatch.setattr(Q, "STEPS", 16 if most < 100 else Q.STEPS)
    frame, rows = frame_of(spark, kind)
    inside = []
    refined = Q._refined
    monkeypatch.setattr(Q, "_refined", lambda f, g, keys, values: (inside.extend(values_inside(f, g, values)), refined(f, g, keys, values))[1])
    found = Q.grouped_quantiles(frame, ["k"], {f"q{i}": (F.col("x"), Q.share(p)) for i, p in enumerate(SHARES)}, {"n": None, "known": F.col("x")})
    assert found.columns == ["k", "n", "known", *[f"q{i}" for i in range(len(SHARES))]]
    expected = by_hand(rows)
    got = {r.k: (r.n, r.known, [r[f"q{i}"] for i in range(len(SHARES))]) for r in found.collect()}
    assert got.keys() == expected.keys()
    for k, (n, known, values) in expected.items():
        assert got[k][:2] == (n, known)
        assert got[k][2] == (pytest.approx(values) if known else values)
    if most < 100 and kind == "skewed":
        assert max(inside) <= 100  # of 18,000 in the hot group


def values_inside(frame, groups, values):
    edges = {r["k"]: r for r in groups.collect()}
    rows = [r.asDict() for r in frame.collect()]
    return [len({r[v] for r in rows if r["k"] == k and r[v] is not None and e[f"_low{t}"] <= r[v] <= e[f"_high{t}"]}) for k, e in edges.items() for t, v in enumerate(values) if e[f"_low{t}"] is not None]


def test_one_row(spark):
    frame, rows = frame_of(spark, "skewed")
    xs = [x for _, x in rows]
    row = Q.quantile_row(frame, {"x": F.col("x"), "none": F.lit(None).cast("double")}, [0.4, 0.5]).first()
    assert row.x == pytest.approx(list(np.quantile(xs, [0.4, 0.5]))) and row.none == [None, None]
    assert Q.smallest(frame, F.col("x"), 100).first().cut == sorted(xs)[99]
    assert Q.smallest(frame, F.col("x"), 10**9).first().cut == max(xs)


def test_empty(spark):
    empty = spark.createDataFrame([], "k int, x double")
    assert Q.grouped_quantiles(empty, ["k"], {"q": (F.col("x"), Q.share(0.5))}).count() == 0
    assert Q.quantile_row(empty, {"x": F.col("x")}, [0.5]).first().x == [None]
    assert Q.smallest(empty, F.col("x"), 3).first().cut is None


def test_no_task_sees_a_group(spark):
    """The plan has no percentile and no collected list: what is shuffled are sketches, and counts of values in brackets."""
    frame, _ = frame_of(spark, "skewed")
    plan = Q.grouped_quantiles(frame, ["k"], {"q": (F.col("x"), Q.share(0.5))})._jdf.queryExecution().toString()
    assert "collect_list" not in plan and " percentile(" not in plan
