"""Windows in time, archetype metrics, z-scores and the opportunity ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import MONTH_DAYS, PLAY_MODES, AnalysisParams
from .quantiles import grouped_quantiles, quantile_row, share, smallest


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a date or timestamp; whole numbers, so that edges of windows are exact."""
    return F.unix_micros(c.cast("timestamp"))


def span_micros(months: int) -> int:
    return round(months * MONTH_DAYS * 86_400_000_000)


def trailing(items: DataFrame, as_of: str, months: int) -> DataFrame:
    """Rows released no earlier than `months` of 30.44 days before; no upper bound; null dates drop."""
    return items.where(micros(F.col("released")) >= micros(F.lit(as_of)) - span_micros(months))


def simple_cut(items: DataFrame, quantile: float, *, approximate: bool = False) -> DataFrame:
    """Rows whose complexity is at most the quantile of the run; found by ranges, or by a sketch if `approximate`."""
    if approximate:
        cut = items.agg(F.percentile_approx("complexity", quantile, 100_000).alias("_cut"))
    else:
        cut = quantile_row(items, {"_cut": F.col("complexity")}, [quantile]).select(F.col("_cut")[0].alias("_cut"))
    return items.crossJoin(F.broadcast(cut)).where("complexity <= _cut").drop("_cut")  # one row


def simple_tally(items: DataFrame, quantile: float) -> DataFrame:
    cut = quantile_row(items, {"cut": F.col("complexity")}, [quantile]).select(F.col("cut")[0].alias("cut"))
    return items.crossJoin(F.broadcast(cut)).agg(
        F.count_if(F.col("complexity") <= F.col("cut")).alias("simple_size"),
        F.count_if(F.col("complexity") > F.col("cut")).alias("above"),
        F.count_if(F.col("complexity").isNull()).alias("unscored"),
    )


def simple_from_size(items: DataFrame, size: int) -> DataFrame:
    """The subset of a known size again: rows up to the size-th smallest score, ties kept."""
    cut = smallest(items, F.col("complexity"), size).withColumnRenamed("cut", "_cut")
    return items.crossJoin(F.broadcast(cut)).where("complexity <= _cut").drop("_cut")  # one row


#: Quantiles, and counts of rows or of known values, of a cluster.
_DEMAND = {
    "median_sales": ("sales_mid", share(0.5)), "median_reviews": ("review_count", share(0.5)), "sales_q1": ("sales_mid", share(0.25)), "sales_q3": ("sales_mid", share(0.75)),
}
_SIMPLICITY = {"median_complexity": ("complexity", share(0.5))}


def _by_cluster(items: DataFrame, targets: dict, counts: dict[str, str | None]) -> DataFrame:
    named = {out: (F.col(c), place) for out, (c, place) in targets.items()}
    return grouped_quantiles(items, ["cluster_id"], named, {out: None if c is None else F.col(c) for out, c in counts.items()})


def _with_share(grouped: DataFrame) -> DataFrame:
    return grouped.withColumn("share", F.col("releases") / F.sum("releases").over(Window.partitionBy()))  # one row a cluster


def archetype_metrics(items: DataFrame) -> DataFrame:
    """A row for every cluster with the columns of demand, competition and simplicity, and _known; items are read once."""
    return _with_share(_by_cluster(items, _DEMAND | _SIMPLICITY, {"n_items": None, "_known": "sales_mid", "releases": None}))


def demand(items: DataFrame) -> DataFrame:
    """cluster_id, n_items, median sales and reviews, sales quartiles; a cluster without known sales drops."""
    return _by_cluster(items, _DEMAND, {"n_items": None, "_known": "sales_mid"}).where("_known > 0").drop("_known")


def competition(items: DataFrame) -> DataFrame:
    """cluster_id, releases, share of all rows; shares sum to 1."""
    return _with_share(items.groupBy("cluster_id").agg(F.count("*").alias("releases")))


def simplicity(items: DataFrame) -> DataFrame:
    return _by_cluster(items, _SIMPLICITY, {}).where("median_complexity is not null")


def with_z(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`frame`, one row a cluster, with the named z-scores: population deviation over all rows, 0 where there is none."""
    every = Window.partitionBy()
    named = frame.withColumns({f"_x_{k}": c for k, c in columns.items()})
    z = {k: (F.col(f"_x_{k}") - F.avg(f"_x_{k}").over(every)) / F.nullif(F.stddev_pop(f"_x_{k}").over(every), F.lit(0.0)) for k in columns}
    scored = named.withColumns({k: F.when(F.col(f"_x_{k}").isNotNull(), F.coalesce(c, F.lit(0.0))) for k, c in z.items()})
    return scored.select(*frame.columns, *columns)


def ranked(metrics: DataFrame, params: AnalysisParams) -> DataFrame:
    """Archetypes of enough items with their z-scores and opportunity, best first. metrics: see `archetype_metrics`."""
    enough = metrics.where(F.col("n_items") >= params.min_cluster_size)
    scored = with_z(enough, {"demand_z": F.col("median_sales"), "competition_z": F.col("share"), "simplicity_z": 1 - F.col("median_complexity")})
    total = params.demand * F.col("demand_z") - params.competition * F.col("competition_z") + params.simplicity * F.col("simplicity_z")
    return scored.withColumn("opportunity", total).orderBy(F.col("opportunity").desc(), "cluster_id")


def opportunities(demand_: DataFrame, competition_: DataFrame, simplicity_: DataFrame, params: AnalysisParams) -> DataFrame:
    """`ranked` of metrics that are kept in three tables."""
    return ranked(demand_.join(competition_, "cluster_id").join(simplicity_, "cluster_id"), params)


def opportunity_matrix(items: DataFrame, params: AnalysisParams) -> DataFrame:
    """`ranked` of the clusters of `items` with known sales and a known complexity, in one pass over them."""
    return ranked(archetype_metrics(items).where("_known > 0 and median_complexity is not null").drop("_known"), params)


def label_summary(items: DataFrame, labels: DataFrame, *, min_votes: int = 0) -> DataFrame:
    """label, n_items and medians of complexity, sales, positive share and price; null votes drop."""
    joined = labels.where(F.col("votes") >= min_votes).select("item_id", "label").distinct().join(items, "item_id")
    medians = {f"median_{c}": (F.col(c), share(0.5)) for c in ("complexity", "sales_mid", "positive_share", "price")}
    return grouped_quantiles(joined, ["label"], medians, {"n_items": None})


def mode_shares(assignments: DataFrame, labels: DataFrame, modes: dict[str, str] = PLAY_MODES) -> DataFrame:
    """cluster_id and, for each mode, the share of its items that carry the mode's label in the unfiltered labels."""
    flags = labels.groupBy("item_id").agg(*[F.max((F.col("label") == v).cast("double")).alias(k) for k, v in modes.items()])
    joined = assignments.join(flags, "item_id", "left")
    return joined.groupBy("cluster_id").agg(*[F.avg(F.coalesce(k, F.lit(0.0))).alias(k) for k in modes])
