"""Catalog building, the rejection waterfall and its tallies."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import payloads as P
from ..params import FilterParams

COARSE_REASONS = ("missing_key", "too_few_reviews", "too_many_reviews", "free_item", "too_expensive", "blocked_publisher")
RELEASE_REASONS = ("detail_failed", "release_date_unknown", "outside_release_window")


def flatten_pages(pages: DataFrame) -> DataFrame:
    """(page, payload keyed by item id) -> page, item_id, payload; keys that are no whole number are left out."""
    each = pages.select("page", F.explode(F.from_json("payload", "map<string,string>")).alias("key", "payload"))
    return each.withColumn("item_id", F.expr("try_cast(key AS bigint)")).where("item_id is not null").select("page", "item_id", "payload")


def pages_to_keep(pages: DataFrame, *, max_pages: int | None = None, run: str = "run_id") -> DataFrame:
    """Pages before the first one that is empty, that repeats the ids of the page before, or that is number `max_pages`.

    `pages`: run, page, ids (array). A null list of ids is empty.
    """
    ids = F.sort_array(F.coalesce("ids", F.array().cast("array<bigint>")))
    order = Window.partitionBy(run).orderBy("page")
    repeated = F.coalesce(ids == F.lag(ids).over(order), F.lit(False))
    stop = (F.size(ids) == 0) | repeated
    if max_pages is not None:
        stop = stop | (F.col("page") >= max_pages)
    seen = F.max(stop.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return pages.withColumn("_stopped", seen).where("_stopped = 0").drop("_stopped")


def latest_by_key(rows: DataFrame, keys: list[str], arrival: list[str], *, keep: str = "last") -> DataFrame:
    """One row a key: the last or the first by arrival."""
    order = [F.col(c).desc() if keep == "last" else F.col(c).asc() for c in arrival]
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def build_catalog(payload_rows: DataFrame) -> DataFrame:
    """(arrival, item_id, payload) -> the catalog, one row an item: the last to arrive. Bad numbers count as 0."""
    last = latest_by_key(payload_rows, ["item_id"], ["arrival"])
    item = last.select("item_id", F.from_json("payload", P.CATALOG_ITEM).alias("p"))
    whole = lambda c: F.coalesce(F.col(f"p.{c}").try_cast("bigint"), F.lit(0)).alias(c)
    return item.select(
        "item_id", "p.name", F.col("p.developer").alias("maker"), "p.publisher", whole("positive"), whole("negative"),
        F.col("p.owners_low").try_cast("bigint").alias("owners_low"), F.col("p.owners_high").try_cast("bigint").alias("owners_high"),
        P.dollars(F.col("p.price")).alias("price"), P.dollars(F.col("p.initialprice")).alias("initial_price"),
        F.coalesce(F.col("p.discount").try_cast("int"), F.lit(0)).alias("discount"), F.col("p.tags").alias("labels"),
    )


def duplicates(payload_rows: DataFrame) -> DataFrame:
    """One row: how many payloads had an id that others had too, beyond the one kept."""
    return payload_rows.agg((F.count("item_id") - F.countDistinct("item_id")).alias("duplicates"))


def coarse_reason(params: FilterParams) -> Column:
    """The first rule that a catalog row fails, null for a survivor."""
    reviews = F.coalesce("positive", F.lit(0)) + F.coalesce("negative", F.lit(0))
    reason = F.when(F.col("item_id").isNull(), "missing_key").when(reviews < params.min_reviews, "too_few_reviews")
    if params.max_reviews is not None:
        reason = reason.when(reviews > params.max_reviews, "too_many_reviews")
    if not params.include_free:
        reason = reason.when(F.col("price") == 0, "free_item")
    if params.max_price is not None:
        reason = reason.when(F.col("price") > params.max_price, "too_expensive")
    if params.blocked_publishers:
        publisher = F.lower("publisher")
        blocked = F.exists(F.array(*[F.lit(b.lower()) for b in params.blocked_publishers]), lambda b: F.contains(publisher, b))
        reason = reason.when(F.coalesce(blocked, F.lit(False)), "blocked_publisher")
    return reason


def coarse_filter(catalog: DataFrame, params: FilterParams) -> DataFrame:
    """The catalog with reject_reason."""
    return catalog.withColumn("reject_reason", coarse_reason(params))


def release_reason(params: FilterParams) -> Column:
    """The first rule that a candidate's details (success, released) fail, null for a survivor; bounds are inclusive."""
    reason = F.when(~F.coalesce("success", F.lit(False)), "detail_failed")
    if params.released_from or params.released_to:
        reason = reason.when(F.col("released").isNull(), "release_date_unknown")
    if params.released_from:
        reason = reason.when(F.col("released") < F.lit(params.released_from).cast("date"), "outside_release_window")
    if params.released_to:
        reason = reason.when(F.col("released") > F.lit(params.released_to).cast("date"), "outside_release_window")
    return reason


def release_filter(candidates: DataFrame, details: DataFrame, params: FilterParams) -> DataFrame:
    """Candidates joined to details (item_id, success, released date) with reject_reason."""
    return candidates.join(details, "item_id", "left").withColumn("reject_reason", release_reason(params))


def judged(coarse: DataFrame, details: DataFrame, params: FilterParams) -> DataFrame:
    """Both filters in one pass: `coarse` (see `coarse_filter`) with its details, and with the reason of the release filter where the coarse one has none.

    details: one row an item. Only candidates are given theirs."""
    of = details.withColumnRenamed("item_id", "_detail_id")
    joined = coarse.join(of, (F.col("item_id") == F.col("_detail_id")) & F.col("reject_reason").isNull(), "left").drop("_detail_id")
    return joined.withColumn("reject_reason", F.coalesce("reject_reason", release_reason(params)))


def tally(filtered: DataFrame, reasons: tuple[str, ...]) -> DataFrame:
    """reject_reason, n for every reason in `reasons`, 0 where none was rejected."""
    return counts_of(reason_counts(filtered, reasons), reasons)


def reason_counts(filtered: DataFrame, reasons: tuple[str, ...] = COARSE_REASONS + RELEASE_REASONS) -> DataFrame:
    """One row: n_rows, and for every reason how many rows it rejects. One aggregation, from which tally and summary are read."""
    return filtered.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col("reject_reason") == r).alias(r) for r in reasons])


def counts_of(counts: DataFrame, reasons: tuple[str, ...] = COARSE_REASONS + RELEASE_REASONS) -> DataFrame:
    """reject_reason, n: the one row of `reason_counts` as a row a reason."""
    return counts.select(F.inline(F.array(*[F.struct(F.lit(r).alias("reject_reason"), F.col(r).alias("n")) for r in reasons])))


def funnel_summary(counts: DataFrame) -> DataFrame:
    """One row: catalog, candidates, detail_ok, detail_failed, in_window, of the one row of `reason_counts` over `judged`."""
    less = lambda c, reasons: sum((-F.col(r) for r in reasons), F.col(c))
    passed = counts.withColumn("candidates", less("n_rows", COARSE_REASONS)).withColumn("detail_ok", less("candidates", RELEASE_REASONS[:1]))
    return passed.select(F.col("n_rows").alias("catalog"), "candidates", "detail_ok", "detail_failed", less("detail_ok", RELEASE_REASONS[1:]).alias("in_window"))


def with_criteria(summary: DataFrame, params: FilterParams) -> DataFrame:
    """The one-row summary with criteria, the filter's parameters as a struct."""
    values = {k: F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple) else F.lit(v) for k, v in dataclasses.asdict(params).items()}
    kinds = {"min_reviews": "long", "max_reviews": "long", "include_free": "boolean", "max_price": "double", "blocked_publishers": "array<string>"}
    return summary.withColumn("criteria", F.struct(*[c.cast(kinds.get(k, "string")).alias(k) for k, c in values.items()]))


def with_simple_size(funnel: DataFrame, simple_size: DataFrame) -> DataFrame:
    """The one-row funnel with simple_size from a one-row frame; its other columns stay."""
    return funnel.drop("simple_size").join(simple_size.select("simple_size"))
