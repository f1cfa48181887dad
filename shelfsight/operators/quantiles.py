"""Exact quantiles of whole tables and of groups of any size, by bracket and refine.

One aggregation gives every group a count and a mergeable sketch of each column, and from these a low and a high bracket around each
wanted rank. A second one counts what lies below the bracket as one number and what lies in it by value; the rank is read from these few values. What
is shuffled are sketches, counts and the values in brackets, and no buffer holds a group. Where a bracket would hold
more than `MOST` values, as in a group of billions of rows, it is narrowed by more such rounds first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Steps of a sketch's cut points, and the share of a group's rows that a sketch's rank may be off by: far less than a step.
STEPS = 64
ACCURACY = 10_000
MOST = 1_000_000

Place = Callable[[Column], Column]


def share(p: float) -> Place:
    """The place, from 0, of the quantile at `p` among n values, whole or between two."""
    return lambda n: F.lit(p) * (n - 1)


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column | None]:
    """`right` with its keys renamed, and the condition that joins groups, null ones too."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys]
    both = on[0] if on else None
    for c in on[1:]:
        both = both & c
    return renamed, both


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """`left` with the columns of the group's row in `right`; without keys that is one row."""
    if not keys:
        return left.join(F.broadcast(right), how=how)  # one row
    renamed, on = _same(left, right, keys)
    return left.join(renamed, on, how).drop(*[f"_k_{k}" for k in keys])


def _cuts(value: str) -> Column:
    """STEPS + 1 cut points of the values of an SQL expression, the least and the largest among them."""
    return F.expr(f"percentile_approx({value}, array({', '.join(f'{k / STEPS!r}D' for k in range(STEPS + 1))}), {ACCURACY})")


def _bracket(cuts: Column, rank: Column, n: Column) -> tuple[Column, Column]:
    """Cut points that surely enclose ranks `rank` and rank + 1 of the `n` values the sketch has seen."""
    low = F.greatest(F.lit(0), F.floor(STEPS * (rank - 1) / n) - 1).cast("int")
    high = F.least(F.lit(STEPS), F.ceil(STEPS * (rank + 3) / n) + 1).cast("int")
    return F.get(cuts, low), F.get(cuts, high)


def grouped_quantiles(frame: DataFrame, keys: list[str], targets: dict[str, tuple[Column, Place]], counts: dict[str, Column | None] | None = None, *, stored: bool = False) -> DataFrame:
    """A row for every group: keys, `counts` (of rows, or of a column's values), and for each target the value at its place, by linear interpolation.

    Null and NaN are no values; a group without one has null. Groups of null keys are groups. The columns needed are read twice, so they are
    written first unless the frame is a `stored` table.
    """
    counts = counts or {}
    every = [c for c, _ in targets.values()] + [c for c in counts.values() if c is not None]
    names = {c: f"_v{i}" for i, c in enumerate(dict.fromkeys(map(str, every)))}
    known = {names[str(c)]: F.when(~F.isnan(c.cast("double")), c.cast("double")) for c in every}
    values = [names[str(c)] for c, _ in targets.values()]
    frame = frame.select(*keys, *[c.alias(k) for k, c in known.items()])
    frame = frame if stored else written(frame, "values")
    sizes = [(F.count("*") if c is None else F.count(names[str(c)])).alias(out) for out, c in counts.items()]
    aimed = dict.fromkeys(values)
    groups = frame.groupBy(*keys).agg(*sizes, *[F.count(v).alias(f"_n{v}") for v in aimed], *[_cuts(v).alias(f"_c{v}") for v in aimed])
    edges = {}
    for t, (v, (_, place)) in enumerate(zip(values, targets.values())):
        n = F.nullif(F.col(f"_n{v}"), F.lit(0))
        at = place(n).cast("double")
        low, high = _bracket(F.col(f"_c{v}"), F.floor(at), n)
        edges |= {f"_at{t}": at, f"_low{t}": low, f"_high{t}": high}
    groups = groups.select(*keys, *counts, *[f"_n{v}" for v in aimed], *[c.alias(k) for k, c in edges.items()])
    groups = written(groups, "brackets")  # a row a group, read twice
    if frame.count() > MOST * STEPS // 16:  # else no bracket can hold more; counted in the files' footers
        groups = _narrowed(frame, groups, keys, values)
    found = _refined(frame, groups, keys, values)
    picked = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_t") == t, F.col("_value"))).alias(out) for t, out in enumerate(targets)])
    lost = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    sure = [F.when(F.col(f"_n{v}") > 0, F.coalesce(F.col(out), lost)).alias(out) for v, out in zip(values, targets)]
    return _beside(groups, picked, keys, "left").select(*keys, *counts, *sure)


def _refined(frame: DataFrame, groups: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, _t, _value: the value at the place of every target, from the values in its bracket and the count of those below."""
    edges = groups.select(*keys, *[f"_{c}{t}" for t in range(len(values)) for c in ("at", "low", "high")])
    near = _beside(frame.select(*keys, *dict.fromkeys(values)), edges, keys)
    each = [F.struct(F.lit(t).alias("_t"), F.col(f"_at{t}").alias("_at"), F.when(F.col(v) >= F.col(f"_low{t}"), F.col(v)).alias("_x"), (F.col(v) <= F.col(f"_high{t}")).alias("_in")) for t, v in enumerate(values)]
    counts = near.select(*keys, F.inline(F.array(*each))).where("_in").groupBy(*keys, "_t", "_at", "_x").agg(F.count("*").alias("_n"))  # null: all that are below
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_t").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    sides = counts.withColumn("_upto", upto).groupBy(*keys, "_t").agg(
        F.min(F.when(F.col("_upto") > F.floor("_at"), F.col("_x"))).alias("_a"), F.min(F.when(F.col("_upto") > F.ceil("_at"), F.col("_x"))).alias("_b"), F.first("_at").alias("_at")
    )
    part = F.col("_at") - F.floor("_at")
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((1 - part) * F.col("_a") + part * F.col("_b"))
    return sides.select(*keys, "_t", value.alias("_value"))


def _narrowed(frame: DataFrame, groups: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """`groups` with brackets of at most MOST values each, as far as equal values allow: every round sketches what is inside anew."""
    while True:
        near = _beside(frame.select(*keys, *dict.fromkeys(values)), groups.select(*keys, *[f"_{c}{t}" for t in range(len(values)) for c in ("low", "high")]), keys)
        aggs = []
        for t, v in enumerate(values):
            inside = f"CASE WHEN {v} BETWEEN _low{t} AND _high{t} THEN {v} END"
            aggs += [F.count_if(F.col(v) < F.col(f"_low{t}")).alias(f"_below{t}"), F.count(F.expr(inside)).alias(f"_inside{t}"), _cuts(inside).alias(f"_cuts{t}")]
        seen = written(near.groupBy(*keys).agg(*aggs), "brackets")
        wide = [(F.col(f"_inside{t}") > MOST) & (F.get(f"_cuts{t}", F.lit(0)) < F.get(f"_cuts{t}", F.lit(STEPS))) for t in range(len(values))]
        both = _beside(groups, seen, keys, "left")
        edges = {}
        for t, w in enumerate(wide):
            low, high = _bracket(F.col(f"_cuts{t}"), F.floor(f"_at{t}") - F.col(f"_below{t}"), F.col(f"_inside{t}"))
            edges |= {f"_low{t}": F.when(w, low).otherwise(F.col(f"_low{t}")), f"_high{t}": F.when(w, high).otherwise(F.col(f"_high{t}"))}
        tight = both.withColumns({f"_new{k}": c for k, c in edges.items()})
        moved = [F.coalesce((F.col(f"_new{k}") != F.col(k)), F.lit(False)) for k in edges]
        any_moved = moved[0]
        for m in moved[1:]:
            any_moved = any_moved | m
        if tight.where(any_moved).limit(1).count() == 0:
            return groups
        groups = written(tight.drop(*edges).withColumnsRenamed({f"_new{k}": k for k in edges}).select(*groups.columns), "brackets")


def quantile_row(frame: DataFrame, columns: dict[str, Column], shares: list[float], *, stored: bool = False) -> DataFrame:
    """One row: for every name an array of its quantiles at `shares`, by linear interpolation; null where no value is known."""
    targets = {f"{k}_{i}": (c, share(p)) for k, c in columns.items() for i, p in enumerate(shares)}
    return grouped_quantiles(frame, [], targets, stored=stored).select(*[F.array(*[f"{k}_{i}" for i in range(len(shares))]).alias(k) for k in columns])


def smallest(frame: DataFrame, column: Column, size: int, *, stored: bool = False) -> DataFrame:
    """One row, cut: the `size`-th smallest known value, or the largest where there are fewer; null where none is known."""
    return grouped_quantiles(frame, [], {"cut": (column, lambda n: F.least(F.lit(size), n) - 1)}, stored=stored)
