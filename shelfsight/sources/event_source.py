"""Events as a stream by id: rows newer than the last id seen, in ranges of ids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

KEY = "event_id"


def files(path: str) -> ds.Dataset:
    """The Parquet files under `path`, on any store that Arrow reads."""
    store, inside = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return ds.dataset(inside, filesystem=store, format="parquet", partitioning="hive")


def newest(path: str, known: int) -> int:
    """The largest id in the files' footers, or `known` where that is larger. Row groups without statistics are read."""
    most = known
    for fragment in files(path).get_fragments():
        footer = fragment.metadata
        place = footer.schema.names.index(KEY)
        for k in range(footer.num_row_groups):
            stats = footer.row_group(k).column(place).statistics
            if stats is not None and stats.has_min_max:
                most = max(most, stats.max)
            else:
                most = max([most, *pc.drop_null(fragment.subset(row_group_ids=[k]).to_table(columns=[KEY]).column(0)).to_pylist()])
    return most


@dataclass
class Ids(InputPartition):
    """Ids above `after`, up to and with `upto`."""

    after: int
    upto: int


class _Ranges:
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.since, self.most = int(options.get("since", 0)), int(options.get("ids", 1_000_000))

    def ranges(self, after: int, upto: int) -> list[Ids]:
        return [Ids(a, min(a + self.most, upto)) for a in range(after, upto, self.most)]

    def read(self, partition: Ids) -> Iterator[pa.RecordBatch]:
        """Rows of the range; files and row groups of other ids are left out by their statistics."""
        key = ds.field(KEY)
        found = files(self.path).scanner(columns=self.schema.fieldNames(), filter=(key > partition.after) & (key <= partition.upto))
        kinds = to_arrow_schema(self.schema)  # files may have other units of time
        yield from (b.cast(kinds, safe=False) for b in found.to_batches() if b.num_rows)


class _Stream(_Ranges, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {KEY: self.since}

    def latestOffset(self) -> dict:
        return {KEY: newest(self.path, self.since)}

    def partitions(self, start: dict, end: dict) -> list[Ids]:
        return self.ranges(start[KEY], end[KEY])


class _Batch(_Ranges, DataSourceReader):
    def partitions(self) -> list[Ids]:
        return self.ranges(self.since, newest(self.path, self.since))


class EventTail(DataSource):
    """Format "event_tail". Options: path (Parquet files), since (ids above it are read, 0), ids (how many a task reads, 1,000,000). Needs a schema.

    As a stream its offset is an event_id: a batch has the ids above the last batch's largest, whichever files hold them, and a restart goes on from
    the checkpoint's id. Ids are given in ascending order by their writers; one that appears behind a larger id already read is not seen.
    """

    @classmethod
    def name(cls) -> str:
        return "event_tail"

    def schema(self) -> str:
        raise ValueError("event_tail needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, self.options)
