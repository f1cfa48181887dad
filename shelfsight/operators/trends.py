"""Sub-windows of the trailing window, counted back from its end, and the slope over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import grouped_quantiles, share
from .scoring import micros, span_micros

SUB_WINDOWS = 4


def trend_windows(items: DataFrame, *, months: int, as_of: str | None = None, parts: int = SUB_WINDOWS) -> DataFrame:
    """cluster_id, sub_window, starts, ends, n_items, median_sales; sub-window 0 is the newest.

    A sub-window excludes its start and includes its end; the end of all is `as_of`, or the last release. Those without known
    sales are left out.
    """
    if months % parts:
        raise ValueError(f"months must divide by {parts}")
    width = span_micros(months // parts)
    if as_of is None:
        end = items.agg(F.max(micros(F.col("released"))).alias("_end"))
    else:
        end = items.sparkSession.range(1).select(micros(F.lit(as_of)).alias("_end"))
    at = items.crossJoin(F.broadcast(end)).withColumn("sub_window", F.floor((F.col("_end") - micros(F.col("released"))) / width).cast("int"))
    kept = at.where((F.col("sub_window") >= 0) & (F.col("sub_window") < parts))
    grouped = grouped_quantiles(kept, ["cluster_id", "sub_window", "_end"], {"median_sales": (F.col("sales_mid"), share(0.5))}, {"n_items": None}).where("median_sales is not null")
    edge = lambda k: F.timestamp_micros(F.col("_end") - (F.col("sub_window") + k) * F.lit(width).cast("long"))
    return grouped.select("cluster_id", "sub_window", edge(1).alias("starts"), edge(0).alias("ends"), "n_items", "median_sales")


def trend_slopes(windows: DataFrame) -> DataFrame:
    """cluster_id, slope of median sales on the sub-window's number, n_points; below two points the slope is null.

    Number 0 is the newest, so a negative slope is growth."""
    known = F.when(F.col("median_sales").isNotNull(), F.col("sub_window").cast("double"))
    return windows.groupBy("cluster_id").agg(F.regr_slope("median_sales", known).alias("slope"), F.count(known).alias("n_points"))


def trend_rows(windows: DataFrame, slopes: DataFrame) -> DataFrame:
    """Rows of sub-windows and summary rows in one frame."""
    return windows.unionByName(slopes, allowMissingColumns=True)


def trend_pivot(windows: DataFrame, clusters: list[int] | None = None) -> DataFrame:
    """ends, and the median sales of each cluster as a column; of the listed ones only, if there is a list."""
    return windows.groupBy("ends").pivot("cluster_id", clusters).agg(F.first("median_sales"))
