"""Minimax contiguous partition of documents into shards; every row is handled by DataFrame expressions only.

Documents of equal text are one atomic group. Groups are ordered by text hash; those that would fill half
of an even shard come first, by size, so that a huge group gets a shard of its own. Prefix sums of the
group sizes stay distributed. The smallest feasible capacity is found by binary search, each candidate checked
greedily over a bounded list of prefix sums: at first one every `CELLS`-th of the total, so that a cut is known to
lie in some cells. Only cells that a cut may lie in are then split further, level by level, until the cells
in question are single groups. The capacity is then exact over all groups, at every size, and so are the cuts, which
are placed at the even share of what is left, moved only as far as the capacity demands.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import chunk_count, running_start, staged, table, text_or_empty

SHARDS = 40
CELLS = 1 << 16
ROW_BYTES = 16
KEY = ["text_hash", "text_crc32", "size"]


class Cells:
    """Known prefix sums: cell i is the groups that end in (ends[i], ends[i + 1]]; inner[i] is how many they are."""

    def __init__(self, rows: Iterable[tuple[int, int, int]]):
        """rows: end, inner, key of each cell; the key names the cell to Spark."""
        self.ends, self.inner, self.keys = [0], [], []
        for end, n, key in sorted(rows):
            self.ends.append(end)
            self.inner.append(n)
            self.keys.append(key)
        self.total = self.ends[-1]

    def last_within(self, limit: int) -> tuple[int, int]:
        """Bounds of the last prefix sum that is at most `limit`; equal where the cell is known."""
        i = bisect_right(self.ends, limit) - 1
        if i == len(self.inner) or self.ends[i] == limit or self.inner[i] == 1:
            return self.ends[i], self.ends[i]
        return self.ends[i], limit

    def first_within(self, limit: int) -> tuple[int, int]:
        """Bounds of the first prefix sum that is at least `limit`."""
        j = bisect_left(self.ends, max(0, limit))
        if self.ends[j] == max(0, limit) or self.inner[j - 1] == 1:
            return self.ends[j], self.ends[j]
        return limit, self.ends[j]

    def after(self, low: int, high: int) -> tuple[int, int]:
        """Bounds of the prefix sum that follows one between `low` and `high`."""
        i, j = (min(bisect_right(self.ends, x), len(self.inner)) for x in (low, high))
        known = self.ends[bisect_right(self.ends, low) - 1] == low and i <= len(self.inner) and (low == self.total or self.inner[i - 1] == 1)
        return (self.ends[i] if known else min(low + 1, self.total)), self.ends[j]

    def capacity(self, low: int, shards: int, side: int) -> int:
        """The least capacity, `low` or more, with which greedy cuts reach the end; by the lower (0) or upper (1) bounds of every cut."""
        high = self.total
        while low < high:
            mid, at = (low + high) // 2, 0
            for _ in range(shards):
                at = self.last_within(at + mid)[side]
            low, high = (low, mid) if at == self.total else (mid + 1, high)
        return low

    def cuts(self, largest: int, shards: int) -> tuple[tuple[int, int], list[tuple[int, int]], list[tuple[int, int]]]:
        """Bounds of the capacity, of the ends of all shards, and of every place that these were found by."""
        least = max(largest, -(-self.total // shards))
        most = self.capacity(least, shards, 0)
        least = min(most, self.capacity(least, shards, 1))
        seen, at = [], (0, 0)
        for _ in range(shards):  # greedy cuts of all capacities that are still possible
            at = self.last_within(at[0] + least)[0], self.last_within(at[1] + most)[1]
            seen.append(at)
        enough = [(self.total, self.total)]  # enough[k]: from here on, k shards are enough
        for _ in range(shards):
            low, high = enough[-1]
            enough.append((self.first_within(low - most)[0], self.first_within(high - least)[1]))
        ends, at = [], (0, 0)
        for k in range(shards):
            left = shards - k
            even = [self.last_within(x - (x - self.total) // left)[side] for side, x in enumerate(at)]
            one = self.after(*at)
            at = tuple(max(even[side], one[side], enough[left - 1][side]) for side in (0, 1))
            ends.append(at)
        return (least, most), ends, seen + enough + ends

    def unclear(self, places: list[tuple[int, int]]) -> list[int]:
        """The cells of more than one group that a place between these bounds may lie in."""
        found = set()
        for low, high in places:
            if low < high:
                found |= {i for i in range(bisect_right(self.ends, low) - 1, bisect_left(self.ends, high)) if self.inner[i] > 1}
        return sorted(found)


def _cell_sums(groups: DataFrame) -> list[tuple[int, int, int]]:
    """(end, groups, cell) of the parts of every cell: its first group, and the others. Two parts a cell reach the driver."""
    sums = groups.groupBy("cell").agg(F.min("end").alias("first"), F.max("end").alias("last"), F.count("*").alias("n")).collect()
    return [(r["first"], 1, r["cell"]) for r in sums] + [(r["last"], r["n"] - 1, r["cell"]) for r in sums if r["n"] > 1]


def _listed(df: DataFrame, names: tuple[str, ...], rows: list[tuple[int, ...]]) -> DataFrame:
    """A few rows of whole numbers as a table, from one literal."""
    kind = f"array<struct<{', '.join(f'{n}: long' for n in names)}>>"
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def shard_ends(groups: DataFrame, total: int, largest: int, *, shards: int = SHARDS, cells: int = CELLS) -> tuple[int, list[int]]:
    """The least capacity and the prefix sums that end the shards. groups: end, the sum of sizes up to and with the group.

    The driver gets at most 2 * `cells` sums a level, and a level divides what is unclear by `cells` over a few thousand.
    """
    if not total:
        return 0, [0] * shards
    groups = groups.select("end", F.floor((F.col("end") - 1) / -(-total // cells)).alias("cell"))
    known = Cells(_cell_sums(groups))
    while True:
        capacity, ends, places = known.cuts(largest, shards)
        unclear = known.unclear(places)
        if not unclear:
            return capacity[0], [end for end, _ in ends]
        parts = max(2, cells // len(unclear))
        listed = [(known.keys[i], k, known.ends[i], known.ends[i + 1]) for k, i in enumerate(unclear)]  # fewer than 2 * cells
        bounds = _listed(groups, ("cell", "place", "low", "high"), listed)
        part = F.floor((F.col("end") - 1 - F.col("low")) * parts / (F.col("high") - F.col("low")))
        inside = groups.join(F.broadcast(bounds), "cell").where("end > low and end <= high")
        groups = staged(inside.select("end", (F.col("place") * (parts + 1) + part).alias("cell")), "cells")
        split = set(unclear)
        clear = [(known.ends[i + 1], n, -1) for i, n in enumerate(known.inner) if i not in split]
        known = Cells(clear + _cell_sums(groups))


def prefix_sums(groups: DataFrame, n_groups: int) -> DataFrame:
    """KEY and end, the sum of weights up to and with the group, in the order of KEY: sums of hash ranges, of their chunks, of rows."""
    bits = max(12, (chunk_count(n_groups) - 1).bit_length())
    cut = groups.withColumn("range", F.shiftright("text_hash", 52)).withColumn("chunk", F.shiftright("text_hash", 64 - bits))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut.groupBy("range").agg(F.sum("weight").alias("sum")).select("range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    within = running_start(cut, "range", "chunk", KEY, "weight", "start")
    return within.join(F.broadcast(ranges), "range").select(*KEY, (F.col("base") + F.col("start") + F.col("weight")).alias("end"))  # 4096 ranges


def with_shard(rows: DataFrame, *, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """`rows` (with the columns of KEY) and shard, 0 up; rows of equal KEY are one group."""
    groups = staged(rows.groupBy(*KEY).agg((F.count("*") * F.col("size")).alias("weight")), "groups")
    total, largest, n_groups = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.max("weight"), F.lit(0)), F.count("*")).first()
    is_heavy = F.col("weight") * (2 * shards) > total
    heavy, sum_ = [], 0  # fewer than 2 * shards groups
    for r in groups.where(is_heavy).orderBy(F.col("weight").desc(), *KEY).collect():
        sum_ += r["weight"]
        heavy.append((*(r[k] for k in KEY), sum_))
    light = staged(prefix_sums(groups.where(~is_heavy), n_groups).withColumn("end", F.col("end") + sum_), "sums")
    ends = light.select("end").unionByName(_listed(rows, ("end",), [(h[-1],) for h in heavy]))
    _, cuts = shard_ends(ends, total, largest, shards=shards, cells=cells)
    shard_of_end = lambda end: bisect_left(cuts, end)
    key = F.struct(*KEY)
    literal = lambda r: F.struct(*[F.lit(r[i]).cast("long").alias(k) for i, k in enumerate(KEY)])
    last = light.where(F.col("end").isin(*cuts)).orderBy("end").collect()  # the last groups of `shards` shards at most
    passed = F.size(F.filter(F.array(*[literal(r) for r in last]), lambda k: k < key)) if last else F.lit(0)
    shard = F.lit(sum(c <= sum_ for c in cuts)) + passed
    for r in heavy:
        shard = F.when(key == literal(r), shard_of_end(r[-1])).otherwise(shard)
    return rows.withColumn("shard", shard.cast("int"))


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, row_bytes: int = ROW_BYTES, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null under this law), a row for every row of `docs`.

    Size is the text's UTF-8 bytes plus `row_bytes`. Documents of equal text share a shard; null counts as the empty text. Slots
    count from 0 in each shard, without gaps; repeated rows have slots of their own. A shard may be empty when there are few groups.
    An empty table gives an empty result. Columns besides doc_id and text are not read.
    """
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + row_bytes).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    rows = staged(rows, "rows")
    chunk = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("slot")), F.lit(chunk_count(rows.count())))
    placed = with_shard(rows, shards=shards, cells=cells).withColumn("chunk", chunk).withColumn("one", F.lit(1))
    return running_start(placed, "shard", "chunk", ["text_hash", "doc_id"], "one", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op8_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_sharding": op8_sharding}
ORACLES: dict[str, str] = {}
