"""Landing, tailing and stage state as streams; see also `throttle`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.runs import LEVELS, stage_state
from ..sources.event_source import EventTail
from ..sources.scratch import scratch_dir
from ..sources.tables import EVENT, PAYLOAD, append_payloads
from .throttle import throttled, with_end  # noqa: F401


def land_payloads(spark: SparkSession, inbox: str, path: str, checkpoint: str):
    """Start a query that appends landed JSON payloads, the first of each (run, item, source); it resumes from its checkpoint."""
    arriving = spark.readStream.schema(PAYLOAD).json(inbox)

    def add(batch: DataFrame, _: int) -> None:
        append_payloads(batch.sparkSession, path, batch)

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail_events(spark: SparkSession, path: str, *, since: int = 0, schema: str = EVENT, ids: int = 1_000_000) -> DataFrame:
    """A stream of the rows under `path` with an event_id above `since`, of known levels where there is a level.

    A batch has the ids above the last one's largest, `ids` of them a task; a restarted query goes on from the id in its checkpoint.
    """
    spark.dataSource.register(EventTail)
    rows = spark.readStream.format("event_tail").schema(schema).option("path", path).option("since", since).option("ids", ids).load()
    return rows.where(f"level in {LEVELS}") if "level" in rows.columns else rows


def stage_states(log: DataFrame) -> DataFrame:
    """Stage state of a streaming stage log, for update or complete mode."""
    return stage_state(log)


def settled(stream: DataFrame, label: str, *, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and return what it gave, from the shared folder.

    append: rows of all batches; complete: those of the last batch.
    """
    spark = stream.sparkSession
    folder = f"{scratch_dir(spark)}/shelfsight/{label}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(f"{folder}/rows")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
