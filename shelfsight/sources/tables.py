"""Scans and sinks of run-partitioned Parquet tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payloads import finite, payload_hash
from ..operators.funnel import latest_by_key
from .scratch import written

PAYLOAD = "run_id string, item_id bigint, source string, fetched_at timestamp, http_status int, payload string, payload_sha256 string"
EVENT = "event_id bigint, run_id string, ts timestamp, stage string, level string, message string, progress double"
LEVELS = ("debug", "info", "warning", "error")
ALLOWED_SOURCES = ("catalog", "details", "reviews", "labels")
PAYLOAD_KEY, ARRIVAL = ["run_id", "item_id", "source"], ["fetched_at", "payload_sha256"]
BUCKETS = 16
RESULTS = ("clusters", "matrix", "trends", "labels", "demand", "competition", "simplicity")


def _known_source(source: str) -> None:
    if source not in ALLOWED_SOURCES:
        raise ValueError(f"unknown source {source}")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one with the schema where nothing was written yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def scan_payloads(spark: SparkSession, path: str, run_id: str, source: str) -> DataFrame:
    """Payloads of a run and source, by item; both are partition columns. Of an item that two writers stored, the first to be fetched."""
    _known_source(source)
    own = read_table(spark, path, PAYLOAD).where((F.col("run_id") == run_id) & (F.col("source") == source))
    return latest_by_key(own, ["item_id"], ARRIVAL, keep="first").orderBy("item_id")


def bundle(spark: SparkSession, path: str, run_id: str) -> dict[str, DataFrame]:
    return {s: scan_payloads(spark, path, run_id, s) for s in ALLOWED_SOURCES}


def fetched_ids(spark: SparkSession, path: str, run_id: str, source: str) -> DataFrame:
    return scan_payloads(spark, path, run_id, source).select("item_id").distinct()


def ids_to_fetch(candidates: DataFrame, fetched: DataFrame) -> DataFrame:
    return candidates.select("item_id").distinct().join(fetched, "item_id", "left_anti")


def scan_items(items: DataFrame, run_id: str, *, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Items of a run; projection and predicate reach the scan. An unknown column is an error."""
    if unknown := set(columns or []) - set(items.columns):
        raise ValueError(f"unknown columns {sorted(unknown)}")
    out = items.where(F.col("run_id") == run_id)
    out = out.where(F.expr(where)) if where else out
    return out.select(*columns) if columns else out


def store_items(frame: DataFrame, path: str, *, order: list[str] = ("item_id",), blooms: list[str] = ()) -> None:
    """Replace the runs in `frame`, each in files sorted by `order`, with a bloom filter for each column in `blooms`.

    Scans of such a table skip runs by their folders, files and row groups by the least and largest values of `order`, and row groups that lack a looked-up value."""
    sorted_ = json_safe(frame).repartitionByRange("run_id", *order).sortWithinPartitions("run_id", *order)
    out = sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
    for c in blooms:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)


def scan_labels(labels: DataFrame, run_id: str, *, min_votes: int = 0) -> DataFrame:
    """Labels of a run; null votes stay when min_votes is 0 and drop above."""
    out = labels.where(F.col("run_id") == run_id)
    return out.where(F.col("votes") >= min_votes) if min_votes > 0 else out


def add_payloads(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """The rows of `arriving` to append: per run, item and source the first to arrive, unless one is stored already."""
    known = arriving.where(F.col("source").isin(*ALLOWED_SOURCES)).join(stored.select(*PAYLOAD_KEY), PAYLOAD_KEY, "left_anti")
    return latest_by_key(known, PAYLOAD_KEY, ARRIVAL, keep="first")


def _key_table(path: str) -> str:
    return f"stored_keys_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def stored_keys(spark: SparkSession, path: str, *, buckets: int = BUCKETS) -> DataFrame:
    """run_id, item_id, source of all payloads stored under `path`: a table of its own beside them, in buckets by these columns."""
    name, columns = _key_table(path), ", ".join(PAYLOAD_KEY)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (run_id STRING, item_id BIGINT, source STRING) USING parquet CLUSTERED BY ({columns}) INTO {buckets} BUCKETS LOCATION '{path}_keys'")
    return spark.table(name)


def fresh_payloads(spark: SparkSession, path: str, arriving: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """What is new in `arriving`, with the hash of its payload. It is dealt out like the stored keys, so that these are joined where they
    lie: only what arrives is shuffled, however many keys are stored."""
    hashed = arriving.withColumn("payload_sha256", payload_hash(F.col("payload")))
    return add_payloads(stored_keys(spark, path, buckets=buckets), hashed.repartition(buckets, *PAYLOAD_KEY))


def append_payloads(spark: SparkSession, path: str, arriving: DataFrame, *, buckets: int = BUCKETS) -> None:
    """Append what is new: payloads first, then their keys. A batch that is broken off between the two, and writers at the same time, can store a key twice; readers
    take the first of it."""
    fresh = written(fresh_payloads(spark, path, arriving, buckets=buckets), "fresh")
    fresh.write.mode("append").partitionBy("run_id", "source").parquet(path)
    keys = stored_keys(spark, path, buckets=buckets)
    fresh.select(*keys.columns).repartition(buckets, *PAYLOAD_KEY).write.insertInto(_key_table(path))


def _valid_event() -> Column:
    progress = F.col("progress")
    return F.coalesce(F.col("level").isin(*LEVELS) & (progress.isNull() | progress.between(0, 1)), F.lit(False))


def valid_events(events: DataFrame) -> DataFrame:
    """Events of a known level whose progress is unknown or a share."""
    return events.where(_valid_event())


def append_events(path: str, events: DataFrame) -> None:
    """Append events to a run's partition. One of an unknown level, or whose progress is no share, is an error, and nothing is written."""
    if events.where(~_valid_event()).limit(1).count():
        raise ValueError(f"levels are {LEVELS}, progress is in [0, 1]")
    events.write.mode("append").partitionBy("run_id").parquet(path)


def find_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The row of a run, or none."""
    return runs.where(F.col("run_id") == run_id)


def check_unique(frame: DataFrame, keys: list[str]) -> None:
    if frame.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"rows are not unique by {keys}")


def replace_run(frame: DataFrame, path: str, run_id: str, *, keys: list[str], required: list[str] = ()) -> None:
    """Replace one run's partition: checked columns and key, NaN and infinity as null. An empty frame empties the partition."""
    if lacking := set(required) - set(frame.columns):
        raise ValueError(f"columns lacking: {sorted(lacking)}")
    check_unique(frame, keys)
    clean = json_safe(frame)
    target = f"{path}/run_id={run_id}"
    clean.drop("run_id").write.mode("overwrite").parquet(target)


def replace_runs(frame: DataFrame, path: str, *, keys: list[str], required: list[str] = ()) -> None:
    """Replace the partitions of all runs in `frame` in one write, checked as by `replace_run`; other runs stay as they are."""
    if lacking := {"run_id", *required} - set(frame.columns):
        raise ValueError(f"columns lacking: {sorted(lacking)}")
    if frame.where(F.col("run_id").isNull()).limit(1).count():
        raise ValueError("a row without a run")
    check_unique(frame, ["run_id", *keys])
    json_safe(frame).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def json_safe(frame: DataFrame) -> DataFrame:
    """Doubles and floats that are NaN or infinite become null."""
    return frame.withColumns({c: finite(F.col(c)) for c, kind in frame.dtypes if kind in ("double", "float")})


def to_json_rows(frame: DataFrame) -> DataFrame:
    """One JSON text a row."""
    clean = json_safe(frame)
    return clean.select(F.to_json(F.struct(*clean.columns)).alias("json"))


def write_result(frame: DataFrame, path: str, run_id: str, kind: str, version: str) -> None:
    """Replace the result of a run and kind. NaN or infinity in it is an error."""
    if kind not in RESULTS:
        raise ValueError(f"unknown result {kind}")
    doubles = [c for c, t in frame.dtypes if t in ("double", "float")]
    bad = sum((F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))) for c in doubles), F.lit(0))
    if doubles and frame.agg(bad).first()[0]:
        raise ValueError("a result has no NaN or infinity")
    frame.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/{kind}/run_id={run_id}")


def read_result(spark: SparkSession, path: str, run_id: str, kind: str, schema: str) -> DataFrame:
    """A stored result, or no rows of its schema."""
    return read_table(spark, f"{path}/{kind}/run_id={run_id}", schema)


def delete_run(spark: SparkSession, paths: list[str], run_id: str) -> None:
    """Drop a run's partition from every table."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{p}/run_id={run_id}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
