"""Labels that occur together: counts, Jaccard similarity, popularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .features import rank_labels


def without_generic(labels: DataFrame, most_share: float) -> DataFrame:
    """Labels on more than this share of the labelled items are dropped; 1.0 drops none."""
    if most_share >= 1:
        return labels
    labels = written(labels, "labelled")  # read three times
    total = labels.agg(F.countDistinct("item_id").alias("_items"))
    counts = labels.groupBy("label").agg(F.countDistinct("item_id").alias("_n"))
    generic = counts.crossJoin(F.broadcast(total)).where(F.col("_n") > most_share * F.col("_items")).select("label")
    return labels.join(generic, "label", "left_anti")


def clustering_labels(labels: DataFrame, *, min_votes: int, generic_share: float, most: int) -> DataFrame:
    """The labels that clustering sees: enough votes, none generic, the first `most` of an item by rank."""
    return rank_labels(without_generic(labels.where(F.col("votes") >= min_votes), generic_share), most)


def label_kinds(labels: DataFrame) -> DataFrame:
    """kind, labels (sorted, each once), n_items: the sets of labels that items have, with how many have just these. A stored table.

    Whatever depends on an item's labels alone is found from these; labels of an item are capped. There are never more kinds than items."""
    per_item = labels.groupBy("item_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    kinds = per_item.groupBy("labels").agg(F.count("*").alias("n_items"))
    return written(kinds.withColumn("kind", F.monotonically_increasing_id()), "kinds")


def kind_labels(kinds: DataFrame) -> DataFrame:
    """label, n_items: a row for every label of every kind."""
    return kinds.select(F.explode("labels").alias("label"), "n_items")


def together(kinds: DataFrame) -> DataFrame:
    """a, b, both for labels a < b: how many items carry both. Pairs are made inside a kind of items."""
    ls = F.col("labels")
    pairs = kinds.select(
        F.explode(F.flatten(F.transform(ls, lambda a, i: F.transform(F.slice(ls, i + 2, F.size(ls)), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"), "n_items"
    )
    return pairs.groupBy("p.a", "p.b").agg(F.sum("n_items").alias("both"))


def jaccard(labels: DataFrame) -> DataFrame:
    """a, b, both, distance for labels that share an item; a pair that is absent is at distance 1."""
    return kinds_jaccard(label_kinds(labels))


def kinds_jaccard(kinds: DataFrame) -> DataFrame:
    counts = kind_labels(kinds).groupBy("label").agg(F.sum("n_items").alias("n"))
    na, nb = (counts.select(F.col("label").alias(k), F.col("n").alias(f"n_{k}")) for k in "ab")
    joined = together(kinds).join(na, "a").join(nb, "b")
    return joined.select("a", "b", "both", (1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("distance"))


def jaccard_matrix(labels: DataFrame, *, most_labels: int = 5_000) -> DataFrame:
    """Every pair of the vocabulary with its distance, for a vocabulary small enough to look at; a larger one is an error.

    `jaccard` has the pairs that share an item, which is all there is to know, for any vocabulary."""
    names = labels.select("label").distinct()
    if names.limit(most_labels + 1).count() > most_labels:
        raise ValueError(f"more than {most_labels} labels: use jaccard")
    sparse = jaccard(labels)
    both_ways = sparse.select("a", "b", "distance").unionByName(sparse.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    grid = names.select(F.col("label").alias("a")).crossJoin(names.select(F.col("label").alias("b")))
    return grid.join(both_ways, ["a", "b"], "left").withColumn("distance", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.coalesce("distance", F.lit(1.0))))


def popularity(labels: DataFrame) -> DataFrame:
    """label, popularity: every item adds the number of its labels, the row sum of the co-occurrence matrix."""
    sizes = labels.groupBy("item_id").agg(F.countDistinct("label").alias("n"))
    return labels.select("item_id", "label").distinct().join(sizes, "item_id").groupBy("label").agg(F.sum("n").alias("popularity"))
