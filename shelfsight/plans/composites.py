"""Composite plans: enrichment, analysis, report and freezing of bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import funnel as U
from ..operators import scoring as S
from ..operators import trends as T
from ..operators.affinity import clustering_labels, kind_labels, kinds_jaccard, label_kinds
from ..operators.archetypes import cluster_labels, linkage, search_threshold
from ..operators.report import headline, label_view, matrix_view
from ..operators.runs import run_summary
from ..operators.select import case_rows, diverse_top
from ..params import STAGES, AnalysisParams, FeatureParams, FilterParams
from ..sources.scratch import written


def score_items(items: DataFrame, labels: DataFrame, params: FeatureParams) -> DataFrame:
    """Sales, revenue, complexity and return of normalised items that have maker_titles."""
    return X.with_return(X.complexity(X.with_revenue(X.with_sales(items, params), params), labels, params), params)


def enrich(catalog: DataFrame, details: DataFrame, reviews: DataFrame, label_source: DataFrame, params: FeatureParams) -> tuple[DataFrame, DataFrame]:
    """(enriched items, labels) of the payloads. Makers are counted over the whole catalog, medians over items in scope."""
    labels = X.extract_labels(label_source, params)
    normal = written(X.normalize_items(catalog, details, reviews, label_source, params), "normal")  # else the filter below parses anew
    scoped = X.maker_titles(normal, catalog).where("in_scope")
    return score_items(scoped, labels, params), labels


def funnel(payload_rows: DataFrame, details: DataFrame, params: FilterParams) -> dict[str, DataFrame]:
    """Catalog, both filters, the merged tally and the summary; these two are read from one pass over the payloads. details: item_id, success, released, one row an item."""
    coarse = U.coarse_filter(U.build_catalog(payload_rows), params)
    released = U.release_filter(coarse.where("reject_reason is null").drop("reject_reason"), details, params)
    counts = U.reason_counts(U.judged(coarse, details, params))
    return {"coarse": coarse, "released": released, "tally": U.counts_of(counts), "summary": U.with_criteria(U.funnel_summary(counts), params)}


def analyse(items: DataFrame, labels: DataFrame, as_of: str, params: AnalysisParams) -> dict[str, DataFrame]:
    """Everything after the simplicity cut uses the simple subset only. labels are read once: views of the subset take its own."""
    simple = written(S.simple_cut(items, params.simple_quantile), "simple")
    found = cluster_labels(labels, simple, params)
    placed = simple.join(found.assignments, "item_id")
    placed = written(placed, "placed")
    recent = S.trailing(placed, as_of, params.window_months)
    metrics = written(S.archetype_metrics(recent), "metrics")  # one row a cluster
    demand = metrics.where("_known > 0").select("cluster_id", "n_items", "median_sales", "median_reviews", "sales_q1", "sales_q3")
    competition, simplicity = metrics.select("cluster_id", "releases", "share"), metrics.select("cluster_id", "median_complexity").where("median_complexity is not null")
    matrix = S.ranked(metrics.where("_known > 0 and median_complexity is not null").drop("_known"), params)
    named = matrix.join(found.names.select("cluster_id", "name"), "cluster_id", "left").join(found.shares, "cluster_id", "left")
    windows = T.trend_windows(placed, months=params.window_months)
    slopes = T.trend_slopes(windows)
    return {
        "simple": simple, "placed": placed, "assignments": found.assignments, "names": found.names, "demand": demand, "competition": competition,
        "simplicity": simplicity, "matrix": named, "trends": T.trend_rows(windows, slopes),
        "labels": S.label_summary(simple, found.own, min_votes=params.min_votes),
    }


def analysis_report(items: DataFrame, simple: DataFrame, assignments: DataFrame, demand: DataFrame, params: AnalysisParams) -> DataFrame:
    """One row: candidates, simple_size, clusters, scored, below_minimum."""
    few = F.col("n_items") < params.min_cluster_size
    scored = demand.agg(F.count_if(~few).alias("scored"), F.count_if(few).alias("below_minimum"))
    sizes = items.agg(F.count("*").alias("candidates")).join(simple.agg(F.count("*").alias("simple_size")))
    return sizes.join(assignments.agg(F.countDistinct("cluster_id").alias("clusters"))).join(scored)  # one row each


def picked_labels(picked: DataFrame, labels: DataFrame, most: int = 20) -> DataFrame:
    """The ranked labels of the picked items, a few rows: the labels of all others are not ranked."""
    return X.rank_labels(labels.join(F.broadcast(picked.select("item_id")), "item_id", "left_semi"), most)


def report(found: dict[str, DataFrame], items: DataFrame, labels: DataFrame, summary: DataFrame, *, run: DataFrame | None = None, stages: DataFrame | None = None, stage_order: tuple[str, ...] = STAGES) -> dict[str, DataFrame]:
    """The views of a run's analysis, labels (item_id, label, votes) ranked for its cases; with `run` and `stages`, also its duration, missing stages and notice."""
    placed = found["placed"]
    picked = written(diverse_top(placed), "picked")
    cases = case_rows(picked, placed, found["names"], picked_labels(picked, labels))
    return {
        "matrix": matrix_view(found["matrix"]), "labels": label_view(found["labels"]), "cases": cases.orderBy("place"),
        "headline": headline(found["matrix"], found["names"], summary), "trends": found["trends"],
    } | ({} if run is None else {"run": run_summary(run, stages, stage_order)})


def freeze(items: DataFrame, labels: DataFrame, params: AnalysisParams, *, upto: float = 1.0) -> tuple[DataFrame, float | None, str]:
    """Bounds of the log features, and the distance threshold searched on the simple subset, among distances up to `upto`."""
    bounds = X.frozen_bounds(items)
    simple = S.simple_cut(items, params.simple_quantile)
    own = labels.join(simple.select("item_id"), "item_id", "left_semi")
    seen = clustering_labels(own, min_votes=params.min_votes, generic_share=params.generic_share, most=params.max_labels)
    kinds = label_kinds(seen)
    _, merges = linkage(kind_labels(kinds).select("label").distinct(), kinds_jaccard(kinds), method=params.linkage, threshold=upto)
    return bounds, *search_threshold(seen, merges, most_share=params.max_cluster_share, kinds=kinds)
