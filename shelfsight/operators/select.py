"""Greedy top-N under two caps, and the rows of its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def diverse_top(items: DataFrame, *, top_n: int = 15, per_cluster: int = 2, per_maker: int = 1) -> DataFrame:
    """item_id, place, relaxed: best effort_return first, at most `per_cluster` of a cluster and `per_maker` of a maker.

    When that gives fewer than top_n, relaxed is true and a second pass with one more a cluster adds to the end. Makers that are
    null count as one. items: item_id, cluster_id, maker, effort_return. Windows first drop what no pass can pick: below
    the best `per_maker` of a (cluster, maker), below the best top_n + per_cluster + 1 of a cluster, and below the best
    (top_n + 1) * per_maker of a maker, as at most top_n clusters are full before the list is. Of what is left a pass skips only rows of full
    clusters and makers, of which there are at most top_n each, so it ends within a known number of rows: these are folded in one array.
    """
    ranked = items.where("effort_return is not null and cluster_id is not null")
    order = [F.col("effort_return").desc(), F.col("item_id")]
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id", "maker").orderBy(*order))).where(F.col("_r") <= per_maker)
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))).where(F.col("_r") <= top_n + per_cluster + 1)
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("maker").orderBy(*order))).where(F.col("_r") <= (top_n + 1) * per_maker)
    ranked = ranked.orderBy(*order).limit(top_n * (1 + (top_n + 1) * per_maker + top_n + per_cluster + 1))
    row = F.struct((-F.col("effort_return")).alias("key"), "item_id", "cluster_id", "maker")
    one = ranked.agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def fold(start: Column, cap: int) -> Column:
        def step(picked: Column, r: Column) -> Column:
            same = lambda field: F.size(F.filter(picked, lambda p: p[field].eqNullSafe(r[field])))
            fits = (F.size(picked) < top_n) & (same("cluster_id") < cap) & (same("maker") < per_maker) & (same("item_id") == 0)
            return F.when(fits, F.concat(picked, F.array(r))).otherwise(picked)

        return F.aggregate("rows", start, step)

    first = one.select("rows", fold(F.filter("rows", lambda _: F.lit(False)), per_cluster).alias("first"))
    both = first.withColumn("relaxed", F.size("first") < top_n).withColumn(
        "picked", F.when(F.col("relaxed"), fold(F.col("first"), per_cluster + 1)).otherwise(F.col("first"))
    )
    return both.select(F.posexplode("picked").alias("at", "p"), "relaxed").select("p.item_id", (F.col("at") + 1).alias("place"), "relaxed")


def case_rows(picked: DataFrame, items: DataFrame, names: DataFrame, labels: DataFrame, *, link: str = "", top_labels: int = 3, top_drivers: int = 5) -> DataFrame:
    """The chosen items with sales band, leading labels, largest contributions to complexity, rationale and link.

    items: with contributions (struct), see `complexity`; names: cluster_id, name; labels: item_id, label, rank.
    """
    top = labels.where(F.col("rank") <= top_labels).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("t"))
    top = top.select("item_id", F.transform("t", lambda s: s["label"]).alias("top_labels"))
    archetypes = names.select("cluster_id", F.col("name").alias("archetype"))
    joined = picked.join(items, "item_id").join(archetypes, "cluster_id", "left").join(top, "item_id", "left")
    parts = items.schema["contributions"].dataType.fieldNames()
    driver = F.array(*[F.struct((-F.coalesce(F.col(f"contributions.{p}"), F.lit(0.0))).alias("v"), F.lit(p).alias("f")) for p in parts])
    return joined.select(
        "place", "item_id", "maker", "cluster_id", "archetype", "price", "review_count", "effort_return", "relaxed",
        F.struct(F.col("sales_low").alias("low"), F.col("sales_mid").alias("mid"), F.col("sales_high").alias("high")).alias("sales"),
        F.coalesce("top_labels", F.array().cast("array<string>")).alias("top_labels"),
        F.transform(F.slice(F.array_sort(driver), 1, top_drivers), lambda d: d["f"]).alias("drivers"),
        T.rationale(F.col("review_count"), F.col("positive_share"), F.col("price"), F.col("size_bytes"), F.col("maker_titles"), F.col("archetype")).alias("rationale"),
        T.item_link(link, F.col("item_id")).alias("link"),
    )
