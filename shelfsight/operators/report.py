"""Views for display: rounding, names, sorting, headline and empty columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Decimal places of the shown columns.
PLACES = {
    "demand_z": 2, "competition_z": 2, "simplicity_z": 2, "opportunity": 2, "median_sales": 0, "median_complexity": 2,
    "singleplayer_share": 2, "multiplayer_share": 2, "coop_share": 2, "median_sales_mid": 0, "median_positive_share": 2, "median_price": 0,
}


def rounded(frame: DataFrame, places: dict[str, int] = PLACES) -> DataFrame:
    """Half to even, only the columns that are there."""
    return frame.withColumns({c: F.bround(c, n) for c, n in places.items() if c in frame.columns})


def renamed(frame: DataFrame, titles: dict[str, str]) -> DataFrame:
    """Titled columns first, in the order of the titles; the others keep name and place."""
    named = [F.col(c).alias(t) for c, t in titles.items() if c in frame.columns]
    return frame.select(*named, *[F.col(c) for c in frame.columns if c not in titles])


def matrix_view(matrix: DataFrame, *, sort_by: str = "opportunity", min_items: int = 0) -> DataFrame:
    """Rows of enough items, rounded, sorted by the rounded column, nulls last, then by cluster."""
    if sort_by not in matrix.columns:
        raise ValueError(f"no column {sort_by}")
    return rounded(matrix.where(F.col("n_items") >= min_items)).orderBy(F.col(sort_by).desc_nulls_last(), "cluster_id")


def label_view(summary: DataFrame, *, top_n: int = 100) -> DataFrame:
    if top_n < 1:
        raise ValueError("top_n is at least 1")
    return rounded(summary).orderBy(F.col("n_items").desc(), "label").limit(top_n)


def top_rows(frame: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """A chart's feed: the first `n` by a column, descending."""
    return frame.orderBy(F.col(by).desc_nulls_last(), tie).limit(n)


def headline(matrix: DataFrame, names: DataFrame, funnel: DataFrame) -> DataFrame:
    """One row: the best archetype's name and score beside the funnel's sizes; nulls when there is none."""
    best = matrix.agg(F.max_by(F.struct("cluster_id", "opportunity"), F.struct("opportunity", -F.col("cluster_id"))).alias("b"))
    best = best.select(F.col("b.cluster_id").alias("cluster_id"), F.col("b.opportunity").alias("opportunity"))
    named = best.join(names.select("cluster_id", "name"), "cluster_id", "left")
    return funnel.join(named)  # one row beside one row


def without_empty(frame: DataFrame) -> DataFrame:
    """The columns that have a value in some row; one pass counts all."""
    if not frame.columns:
        return frame
    counts = frame.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(frame.columns)]).first()
    return frame.select(*[F.col(f"`{c}`") for i, c in enumerate(frame.columns) if counts[i]])


def typed(frame: DataFrame | None, empty: DataFrame) -> DataFrame:
    """`frame` with all columns of `empty`, null where it lacks them; `empty` itself where there is none."""
    return empty if frame is None else empty.unionByName(frame, allowMissingColumns=True).select(*empty.columns)
