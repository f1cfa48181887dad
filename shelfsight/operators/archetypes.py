"""Archetypes: agglomerative clustering of labels by rounds of reciprocal nearest neighbours, votes and names.

Single, complete, average and weighted linkage are reducible, so merging all reciprocal nearest pairs of a round
gives the same tree as merging one pair at a time. State is a sparse edge table: clusters without a shared item are at
distance 1 and have no edge. Clusters are named by their smallest label; ties go to the smaller names, so
results do not depend on partitioning. All tables here are bounded by the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import AnalysisParams
from ..sources.scratch import written
from .affinity import clustering_labels, kind_labels, kinds_jaccard, label_kinds, popularity
from .quantiles import grouped_quantiles, share
from .scoring import mode_shares

TOLERANCE_PLACES = 12


def linkage(vocabulary: DataFrame, edges: DataFrame, *, method: str = "average", threshold: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(label, root) and the merges (distance, a, b) with distance at most `threshold`.

    vocabulary: label; edges: a < b, distance below 1. From a threshold of 1 on all labels are one cluster.
    An edge carries its clusters' sizes, so a round needs no other table.
    """
    one = F.lit(1).cast("long")
    now = written(edges.select("a", "b", (1 - F.col("distance")).alias("s"), one.alias("na"), one.alias("nb")), "edges")
    rounds: list[DataFrame] = []
    while True:
        near = F.col("s") / (F.col("na") * F.col("nb")) if method == "average" else F.col("s")
        pair = now.select(F.struct(F.round(1 - near, TOLERANCE_PLACES).alias("distance"), "a", "b", (F.col("na") + F.col("nb")).alias("size")).alias("p"))
        nearest = (
            pair.where(F.col("p.distance") <= threshold)
            .select(F.explode(F.array("p.a", "p.b")).alias("node"), "p")
            .groupBy("node")
            .agg(F.min("p").alias("p"))
        )
        mutual = written(nearest.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select("p.*"), "merges")
        if mutual.limit(1).count() == 0:
            break
        rounds.append(mutual)
        now = written(_merged_edges(now, mutual, method), "edges")
    merges = rounds[0] if rounds else mutual
    for more in rounds[1:]:
        merges = merges.unionByName(more)
    merges = merges.select("distance", "a", "b")
    members = _roots(vocabulary, merges)
    if threshold >= 1:
        left = members.select("root").distinct()
        first = left.agg(F.min("root").alias("_first"))
        rest = left.crossJoin(F.broadcast(first)).where("root <> _first").select(F.lit(1.0).alias("distance"), F.col("_first").alias("a"), F.col("root").alias("b"))
        merges = merges.unionByName(rest)
        members = members.drop("root").crossJoin(F.broadcast(first)).withColumnRenamed("_first", "root")
    return members.select("label", "root"), merges


def _merged_edges(edges: DataFrame, mutual: DataFrame, method: str) -> DataFrame:
    """Edges between the clusters after a round. Which parts an edge had decides how many edges a new one is made of."""
    new = mutual.select(F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("new"), "size")
    out = edges
    for k in "ab":
        names = new.select(F.col("old").alias(f"o{k}"), F.col("new").alias(f"m{k}"), F.col("size").alias(f"s{k}"))
        out = out.join(names, F.col(k) == F.col(f"o{k}"), "left")
        out = out.withColumn(k, F.coalesce(f"m{k}", k)).withColumn(f"n{k}", F.coalesce(f"s{k}", f"n{k}")).withColumn(f"p{k}", F.when(F.col(f"o{k}").isNull(), 1).otherwise(2))
    ends = F.array_sort(F.array(*[F.struct(F.col(k).alias("node"), F.col(f"n{k}").alias("size")) for k in "ab"]))
    out = out.where("a <> b").select(ends.alias("e"), "s", (F.col("pa") * F.col("pb")).alias("parts"))
    total = {
        "average": F.sum("s"),  # s is the sum of similarities of the labels
        "single": F.max("s"),
        "weighted": F.sum(F.col("s") / F.col("parts")),
        "complete": F.when(F.count("*") == F.max("parts"), F.min("s")),  # a part without an edge is at distance 1
    }[method]
    grouped = out.groupBy("e").agg(total.alias("s")).where("s is not null")
    return grouped.select(*[F.col("e")[i]["node"].alias(k) for i, k in enumerate("ab")], "s", *[F.col("e")[i]["size"].alias(f"n{k}") for i, k in enumerate("ab")])


def _roots(vocabulary: DataFrame, merges: DataFrame) -> DataFrame:
    """(label, root) from merges of b into a, each b once: parents of parents until none has one."""
    now = written(vocabulary.join(merges, vocabulary["label"] == merges["b"], "left").select("label", F.coalesce("a", "label").alias("root")), "roots")
    while True:
        up = now.where("label <> root").select(F.col("label").alias("root"), F.col("root").alias("_up"))
        if now.join(up, "root", "left_semi").limit(1).count() == 0:
            return now
        now = written(now.join(up, "root", "left").select("label", F.coalesce("_up", "root").alias("root")), "roots")


def numbered(members: DataFrame, *, first: int = 1) -> DataFrame:
    """label, cluster_id: `first` up by the smallest label of the cluster."""
    ids = members.select("root").distinct().withColumn("cluster_id", F.row_number().over(Window.orderBy("root")) + (first - 1))
    return members.join(ids, "root").select("label", "cluster_id")


def vote(labels: DataFrame, clusters: DataFrame, *extra: str) -> DataFrame:
    """item_id, cluster_id: the cluster with most of the item's labels, ties to the lowest id."""
    counts = labels.join(clusters, "label").groupBy(*extra, "item_id", "cluster_id").agg(F.count("*").alias("n"))
    best = counts.groupBy(*extra, "item_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "cluster_id")).alias("best"))
    return best.select(*extra, "item_id", F.col("best.cluster_id").alias("cluster_id"))


def _jumps(merges: DataFrame) -> list[DataFrame]:
    """Tables (label, up, distance), one for each power of two: the ancestor so many merges above a label, and the distance from which it is one.

    Distances do not fall along a label's ancestors, so the last one decides."""
    levels = [written(merges.select(F.col("b").alias("label"), F.col("a").alias("up"), "distance"), "jumps")]
    while True:
        now = levels[-1]
        above = now.select(F.col("label").alias("up"), F.col("up").alias("_up"), F.col("distance").alias("_distance"))
        more = written(now.join(above, "up").select("label", F.col("_up").alias("up"), F.greatest("distance", "_distance").alias("distance")), "jumps")
        if more.limit(1).count() == 0:
            return levels
        levels.append(more)


def roots_at(vocabulary: DataFrame, levels: list[DataFrame], distances: list[float]) -> DataFrame:
    """distance, label, cluster_id for a few distances: the name of the label's cluster when all merges up to the distance are made."""
    now = vocabulary.select(F.explode(F.array(*map(F.lit, distances))).alias("distance"), "label", F.col("label").alias("root"))
    for jump in reversed(levels):
        step = jump.select(F.col("label").alias("root"), "up", F.col("distance").alias("_from"))
        now = now.join(step, "root", "left").select("distance", "label", F.coalesce(F.when(F.col("_from") <= F.col("distance"), F.col("up")), "root").alias("root"))
    return now.withColumnRenamed("root", "cluster_id")


def _largest(placed: DataFrame) -> dict[float, int]:
    """The most items that a cluster holds, at each of a few distances. placed: distance, cluster_id, n_items."""
    sizes = placed.groupBy("distance", "cluster_id").agg(F.sum("n_items").alias("n"))
    return {r["distance"]: r["n"] for r in sizes.groupBy("distance").agg(F.max("n").alias("n")).collect()}


def search_threshold(labels: DataFrame, merges: DataFrame, *, most_share: float, batch: int = 24, kinds: DataFrame | None = None) -> tuple[float | None, str]:
    """The last merge distance before the largest cluster first holds over `most_share` of the items; else the smallest.

    Items with the same labels vote alike, so the kinds of items (`label_kinds`, made here unless given) vote, each for its number of items. Kinds, merges and partitions stay in tables; to
    the driver come `batch` distances at a time and a number for each. The items that have
    any label of a cluster are at least those that vote for it, and they only become more as clusters merge: the distances up to which no cluster reaches
    `most_share` of the items even so are found by search. From there on items vote, distance by distance, `batch` in one query.
    """
    kinds = label_kinds(labels) if kinds is None else kinds
    voters = written(kinds.select(F.col("kind").alias("item_id"), "n_items", F.explode("labels").alias("label")), "voters")
    levels = _jumps(merges)
    vocabulary, steps = voters.select("label").distinct(), written(merges.select("distance").distinct(), "distances")
    n_items = kinds.agg(F.sum("n_items")).first()[0]
    within = lambda low, high: steps.where((F.col("distance") > low) & (F.col("distance") < high))
    low, high = -float("inf"), float("inf")
    while True:
        cuts = within(low, high).agg(F.percentile_approx("distance", [k / batch for k in range(batch + 1)], 1000)).first()[0]
        if not cuts:
            break
        cuts = sorted(set(cuts))
        reached = voters.join(roots_at(vocabulary, levels, cuts), "label").select("distance", "cluster_id", "item_id", "n_items").distinct()
        found = _largest(reached)
        low, high = max([low, *[d for d in cuts if found[d] / n_items <= most_share]]), min([high, *[d for d in cuts if found[d] / n_items > most_share]])
    last = low if low > -float("inf") else None
    while next_ := [r[0] for r in within(low, float("inf")).orderBy("distance").limit(batch).collect()]:
        found = _largest(vote(voters, roots_at(vocabulary, levels, next_), "distance", "n_items"))
        for d in next_:
            if found[d] / n_items > most_share:
                return (last, "searched") if last is not None else (steps.agg(F.min("distance")).first()[0], "smallest")
            last = d
        low = next_[-1]
    return last, "searched" if last is not None else "none"


def cluster_names(clusters: DataFrame, popular: DataFrame, *, shown: int = 3) -> DataFrame:
    """cluster_id, members, name: its most popular labels, ties by name, joined by ' / '."""
    joined = clusters.join(popular, "label", "left")
    order = F.struct((-F.coalesce("popularity", F.lit(0))).alias("p"), "label")
    grouped = joined.groupBy("cluster_id").agg(F.array_sort(F.collect_list(order)).alias("o"), F.array_sort(F.collect_list("label")).alias("members"))
    top: Column = F.transform(F.slice("o", 1, shown), lambda s: s["label"])
    return grouped.select("cluster_id", "members", F.array_join(top, " / ").alias("name"))


def cluster_statistics(clusters: DataFrame) -> DataFrame:
    """One row: how many clusters, and the median of their labels."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return grouped_quantiles(sizes, [], {"median_members": (F.col("n"), share(0.5))}, {"clusters": None})


@dataclass(frozen=True)
class Archetypes:
    assignments: DataFrame
    clusters: DataFrame
    names: DataFrame
    shares: DataFrame
    threshold: float | None
    source: str
    own: DataFrame


def cluster_labels(labels: DataFrame, items: DataFrame, params: AnalysisParams) -> Archetypes:
    """Archetypes of the items: restrict labels, link, cut at the threshold (or search one), vote, name.

    A single label is cluster 0, without a threshold; no labels give no clusters."""
    own = written(labels.join(items.select("item_id").distinct(), "item_id", "left_semi"), "own")
    seen = written(clustering_labels(own, min_votes=params.min_votes, generic_share=params.generic_share, most=params.max_labels), "labels")
    kinds = label_kinds(seen)
    vocabulary = kind_labels(kinds).select("label").distinct()
    edges = kinds_jaccard(kinds).select("a", "b", "distance")
    if vocabulary.limit(2).count() < 2:
        threshold, source = None, "none"
        members = vocabulary.select("label", F.col("label").alias("root"))
    elif params.distance_threshold is not None:
        threshold, source = params.distance_threshold, "given"
        members, _ = linkage(vocabulary, edges, method=params.linkage, threshold=threshold)
    else:
        _, merges = linkage(vocabulary, edges, method=params.linkage)
        threshold, source = search_threshold(seen, merges, most_share=params.max_cluster_share, kinds=kinds)
        members, _ = linkage(vocabulary, edges, method=params.linkage, threshold=threshold)
    clusters = written(numbered(members, first=0 if source == "none" else 1), "clusters")
    assignments = written(vote(seen, clusters), "assignments")
    return Archetypes(assignments, clusters, cluster_names(clusters, popularity(seen)), mode_shares(assignments, own), threshold, source, own)
