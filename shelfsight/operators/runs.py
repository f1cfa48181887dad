"""Runs, stages and events."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.payloads import inner_object
from ..params import STAGES
from ..sources.scratch import written
from ..sources.tables import LEVELS, valid_events  # noqa: F401
from .quantiles import grouped_quantiles

SOURCES = ("catalog", "details", "reviews", "labels")


def _newest() -> list[Column]:
    return [F.col("started_at").desc_nulls_last(), F.col("run_id").desc_nulls_last()]


def _with_counts(page: DataFrame, items: DataFrame) -> DataFrame:
    """A page of runs with their item counts, in order; only items of these runs are counted."""
    counts = items.join(F.broadcast(page.select("run_id")), "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("n_items"))  # a page of ids
    joined = page.join(counts, "run_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)).cast("long"))
    return joined.orderBy(*_newest())


def list_runs(runs: DataFrame, items: DataFrame, *, limit: int = 50, offset: int = 0) -> DataFrame:
    """Runs with their item count, newest first, ties by run_id descending, one page. A far page is better asked for by `runs_page` or `runs_after`."""
    return _with_counts(runs.orderBy(*_newest()).offset(offset).limit(limit), items)


def runs_after(runs: DataFrame, items: DataFrame, started_at, run_id, *, limit: int = 50) -> DataFrame:
    """The page of `list_runs` behind a run: the last one of the page before. No task keeps more than a page, however deep it lies."""
    at, known = F.lit(started_at).cast(runs.schema["started_at"].dataType), F.col("started_at").isNotNull()
    older = F.col("started_at") < at if started_at is not None else F.lit(False)
    tie = F.col("started_at").eqNullSafe(at) & (F.col("run_id") < F.lit(run_id))
    behind = runs.where(F.coalesce(older, F.lit(False)) | tie | (~known if started_at is not None else F.lit(False)))
    return _with_counts(behind.orderBy(*_newest()).limit(limit), items)


def runs_page(runs: DataFrame, items: DataFrame, page: int, *, limit: int = 50) -> DataFrame:
    """Page number `page`, from 0: the time it starts at is found by rank, and only runs from there on are ordered."""
    micros = F.unix_micros(F.col("started_at").cast("timestamp"))
    skipped = page * limit
    first = grouped_quantiles(runs, [], {"at": (micros, lambda n: F.greatest(n - 1 - skipped, F.lit(0)))}).first()["at"]
    if first is None:
        return list_runs(runs, items, limit=limit, offset=skipped)
    newer = runs.where(micros > int(first)).count()
    rest = runs.where(micros.isNull() | (micros <= int(first)))
    return list_runs(rest, items, limit=limit, offset=skipped - newer)


def stage_state(log: DataFrame) -> DataFrame:
    """run_id, stage, status, attempt, started_at, finished_at from a stage log (run_id, stage, status, ts, seq).

    The latest record gives the status, attempt counts begins, and a restart clears the end.
    """
    order = F.struct("ts", "seq")
    began = F.col("status") == "running"
    return (
        log.groupBy("run_id", "stage")
        .agg(
            F.max_by("status", order).alias("status"),
            F.count_if(began).alias("attempt"),
            F.max(F.when(began, F.col("ts"))).alias("started_at"),
            F.max_by("ts", order).alias("_last"),
        )
        .withColumn("finished_at", F.when(F.col("status") != "running", F.col("_last")))
        .drop("_last")
    )


def in_stage_order(stages: DataFrame, order: tuple[str, ...] = STAGES) -> DataFrame:
    return stages.orderBy(F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stage")))


def partial_runs(stages: DataFrame, order: tuple[str, ...] = STAGES) -> DataFrame:
    """run_id, missing, is_partial: the stages that have not succeeded, in order."""
    done = stages.groupBy("run_id").agg(F.collect_set(F.when(F.col("status") == "succeeded", F.col("stage"))).alias("done"))
    missing = F.array_except(F.array(*[F.lit(s) for s in order]), F.col("done"))
    return done.select("run_id", missing.alias("missing"), (F.size(missing) > 0).alias("is_partial"))


def orphans(runs: DataFrame, live: DataFrame) -> DataFrame:
    """Runs pending or running that no worker holds."""
    return runs.where(F.col("status").isin("pending", "running")).join(live.select("run_id"), "run_id", "left_anti")


def run_seconds(runs: DataFrame, stages: DataFrame) -> DataFrame:
    """run_id, seconds: from start to finish, else from the first stage's start to the last one's end."""
    spans = stages.groupBy("run_id").agg(F.min("started_at").alias("_from"), F.max("finished_at").alias("_to"))
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    joined = runs.join(spans, "run_id", "left")
    return joined.select("run_id", (F.coalesce(at("finished_at") - at("started_at"), at("_to") - at("_from")) / 1e6).alias("seconds"))


def events_after(events: DataFrame, run_id, since: int = 0) -> DataFrame:
    return events.where((F.col("run_id") == run_id) & (F.col("event_id") > since)).orderBy("event_id")


FOLD_ROWS = 100_000


def throttle_info(events: DataFrame, *, gap_seconds: float = 2.0, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Events without info events less than the gap after the last info event kept in their run; other levels all stay.

    Times of a run that has at most `fold_rows` of them are walked through in one task. In longer runs a kept time's successor is
    the first time of its run at least a gap later, and those kept are what a run's first time reaches, found by
    joins that double the steps; no such run or burst is held in one task's memory. Of equal times of a run
    the smallest event_id stands for all; events without a time are all kept, and a repeated row is kept or dropped as one. A null run or id is one as any other.
    """
    gap = int(gap_seconds * 1e6)
    if gap <= 0:
        return events.where(F.col("level").isNotNull())
    timed = F.coalesce((F.col("level") == "info") & F.col("ts").isNotNull(), F.lit(False))
    info = events.where(timed).withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    at = info.groupBy("run_id", "_at").agg(F.min("event_id").alias("event_id"))
    long = at.groupBy("run_id").agg(F.count("*").alias("_n")).where(F.col("_n") > fold_rows).select(F.col("run_id").alias("_run"))
    if long.limit(1).count() == 0:
        kept = _walked(at, gap)
    else:
        at, long = written(at, "throttle-times"), written(long, "throttle-long")
        same_run = at["run_id"].eqNullSafe(long["_run"])
        rest = written(at.join(long, same_run, "left_semi"), "throttle-times")
        reached = _reached(_successors(rest, gap), rest.groupBy("run_id").agg(F.min("_at").alias("_at")))
        same = rest["run_id"].eqNullSafe(reached["run_id"]) & (rest["_at"] == reached["_at"])
        kept = _walked(at.join(long, same_run, "left_anti"), gap).unionByName(rest.join(reached, same, "left_semi"))
    one = kept.select(F.col("run_id").alias("_run"), F.col("_at").alias("_time"), F.col("event_id").alias("_id"))
    same = info["run_id"].eqNullSafe(one["_run"]) & (info["_at"] == one["_time"]) & info["event_id"].eqNullSafe(one["_id"])
    return info.join(one, same, "left_semi").drop("_at").unionByName(events.where(F.col("level").isNotNull() & ~timed))


def _walked(at: DataFrame, gap: int) -> DataFrame:
    """The rows of the times kept, run by run; a step goes to the first time at least `gap` later."""

    def walk(run: pa.Table) -> pa.Table:
        order = np.argsort(run.column("_at").to_numpy())
        times, k, kept = run.column("_at").to_numpy()[order], 0, []
        while k < len(times):
            kept.append(order[k])
            k = np.searchsorted(times, times[k] + gap)
        return run.take(kept)

    return at.groupBy("run_id").applyInArrow(walk, at.schema)


def _successors(at: DataFrame, gap: int) -> DataFrame:
    """run_id, _at, _next: the run's first time at least `gap` later, where there is one.

    Times and times + gap are sorted together and cut into ranges; what is not found in the own range is the first time of
    the run's next range that has any. Only ranges, not rows, of a run come together.
    """
    both = at.select("run_id", F.col("_at").alias("_when"), F.col("_at").alias("_time")).unionByName(
        at.select("run_id", (F.col("_at") + gap).alias("_when"), F.lit(None).cast("long").alias("_time"))
    )
    parts = int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(both.repartitionByRange(parts, "run_id", "_when").withColumn("_range", F.spark_partition_id()), "throttle-ranges")
    # from the latest down, a time before the queries for it, so that the frame is a running one
    later = Window.partitionBy("run_id", "_range").orderBy(F.col("_when").desc(), F.col("_time").desc_nulls_last())
    found = cut.withColumn("_next", F.min("_time").over(later.rowsBetween(Window.unboundedPreceding, 0))).where("_time is null")
    ranges = cut.groupBy("run_id", "_range").agg(F.min("_time").alias("_first"))
    above = Window.partitionBy("run_id").orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("run_id").alias("_run"), F.col("_range").alias("_of"), F.min("_first").over(above).alias("_first"))
    joined = found.join(ranges, found["run_id"].eqNullSafe(F.col("_run")) & (F.col("_range") == F.col("_of")))
    return joined.select("run_id", (F.col("_when") - gap).alias("_at"), F.coalesce("_next", "_first").alias("_next")).where("_next is not null")


def _reached(steps: DataFrame, first: DataFrame) -> DataFrame:
    """run_id, _at of all that `first` reaches by `steps`. After k rounds these are the first 2^k of each chain."""
    # only a run's first time and what is a successor can be on a chain
    nodes = steps.select("run_id", F.col("_next").alias("_at")).unionByName(first).distinct()
    match = lambda a, b, left: a["run_id"].eqNullSafe(b["_run"]) & (a[left] == b["_from"])
    keys = nodes.select(F.col("run_id").alias("_run"), F.col("_at").alias("_from"))
    steps = written(steps.join(keys, match(steps, keys, "_at"), "left_semi"), "throttle-steps")
    reached = written(first, "throttle-reached")
    while steps.limit(1).count():
        to = steps.select(F.col("run_id").alias("_run"), F.col("_at").alias("_from"), F.col("_next").alias("_to"))
        more = reached.join(to, match(reached, to, "_at")).select("run_id", F.col("_to").alias("_at"))
        reached = written(reached.unionByName(more), "throttle-reached")
        steps = written(steps.join(to, match(steps, to, "_next")).select("run_id", "_at", F.col("_to").alias("_next")), "throttle-steps")
    return reached


def run_summary(runs: DataFrame, stages: DataFrame, order: tuple[str, ...] = STAGES) -> DataFrame:
    """run_id, status, seconds, missing (stages not succeeded, in order), is_partial and, for a partial run, a notice; a row for every run.

    A run without any stage lacks all of them."""
    every = F.array(*[F.lit(s) for s in order])
    joined = runs.join(run_seconds(runs, stages), "run_id", "left").join(partial_runs(stages, order), "run_id", "left")
    missing = F.coalesce("missing", every)
    notice = F.concat(F.lit("This run is partial. Missing: "), F.array_join("missing", ", "), F.lit(". Results are those of the stages that ended."))
    told = joined.select("run_id", "status", "seconds", missing.alias("missing"), (F.size(missing) > 0).alias("is_partial"))
    return told.withColumn("notice", F.when(F.col("is_partial"), notice))


def usage(payloads: DataFrame, sources: tuple[str, ...] = SOURCES[1:]) -> DataFrame:
    """run_id, requests: distinct (source, item) of the sources that cost a request each."""
    counted = payloads.where(F.col("source").isin(*sources)).select("run_id", "source", "item_id").distinct()
    return counted.groupBy("run_id").agg(F.count("*").alias("requests"))


def source_outcomes(payloads: DataFrame) -> DataFrame:
    """source, ok, failed: details by their success flag, reviews by success 1, the others by status 200."""
    flag = F.try_variant_get(inner_object(F.col("payload"), F.col("item_id")), "$.success", "string")
    ok = F.when(F.col("source") == "details", flag == "true").when(F.col("source") == "reviews", flag == "1").otherwise(F.col("http_status") == 200)
    ok = F.coalesce(ok, F.lit(False))
    return payloads.groupBy("source").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))
