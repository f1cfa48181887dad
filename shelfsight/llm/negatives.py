"""Hard negatives by inner product, with coordinate lists of length buckets.

Rows are cut into blocks where they are read: a block holds at most `BLOCK` rows of one group of labels whose lengths lie
within `SPREAD` of the longest, and for every coordinate the list of its rows sorted by that coordinate of the unit vector. For an anchor and
a score that a row must reach, the angle between the two is bounded by the block's longest row, and so is the value that the row may have in each
coordinate. The ranges for the anchor's largest coordinates, its focus, are looked up in the sorted lists; rows in all ranges are the candidates, and their
scores are computed exactly in whole numbers. The score to reach rises with the best found so far, longest blocks first.

Anchors meet blocks in the cells of a grid whose two sides are chosen from counts, so that a task sees a bounded number of
anchors and blocks however many there are of each, and however many rows a label has. Nothing is left out: where lists prune nothing, as with scores near zero,
all rows of a block are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import staged, table

SCALE = 256
#: Scaled components are held to this many either way, so that sums of up to 8,192 products stay within 64 bits.
LIMIT = 1 << 25
BLOCK = 1024
SPREAD = 0.8
TASK_ROWS = 8192
LABEL_GROUPS = 16
CELL_BLOCKS = 8
CELL_ANCHORS = 1024
FOCUS = 4
EXACT = float(1 << 52)
SLACK = 1e-9


def usable(rows: DataFrame, *, scale: int = SCALE) -> DataFrame:
    """vec_id, label, vector: rows with an id, a label and finite components, which become floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c * scale))).cast("int"))
    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
    return known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vector"))


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows; short ones end in zeros."""
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))])
    size = np.diff(ends)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _units(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return vectors / np.where(norms > 0, norms, 1.0)[:, None]


BLOCKS = "block long, label_group int, dim int, longest double, ids binary, labels binary, vectors binary, lists binary"


def _cut(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, first: int) -> pa.RecordBatch:
    """Blocks of the rows, numbered from `first`."""
    norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    groups = labels % LABEL_GROUPS
    order = np.lexsort((ids, -norms, groups))
    cuts, at = [], 0
    group, length = groups[order], norms[order]
    while at < len(order):
        end = min(at + BLOCK, int(np.searchsorted(group, group[at], "right")))
        end = at + int(np.searchsorted(-length[at:end], -SPREAD * length[at], "right"))
        cuts.append(order[at:end])
        at = end
    rows = []
    for k, own in enumerate(cuts):
        v = vectors[own]
        lists = np.argsort(_units(v, norms[own]), axis=0, kind="stable").T.astype("<u2")
        rows.append((first + k, int(groups[own[0]]), v.shape[1], float(norms[own[0]]), ids[own].astype("<i8").tobytes(), labels[own].astype("<i8").tobytes(), v.astype("<i4").tobytes(), lists.tobytes()))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks of usable rows, cut task by task without a shuffle; a task holds 4 * TASK_ROWS rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            width = max(v.shape[1] for _, _, v in held)
            wide = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, _, v in held])
            return _cut(np.concatenate([a for a, _, _ in held]), np.concatenate([a for _, a, _ in held]), wide, number)

        for b in batches:
            for at in range(0, b.num_rows, TASK_ROWS):
                part = b.slice(at, TASK_ROWS)
                held.append((part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), matrix(part.column(2))))
                n += part.num_rows
                if n >= 3 * TASK_ROWS:
                    done = flush()
                    yield done
                    number, held, n = number + done.num_rows, [], 0
        if n:
            yield flush()

    return rows.select("vec_id", "label", "vector").mapInArrow(run, BLOCKS)


@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lists: np.ndarray
    longest: float

    def __post_init__(self):
        self.numbers = self.vectors.astype(float)
        norms = np.sqrt((self.numbers**2).sum(axis=1))
        units = _units(self.numbers, norms)
        self.sorted = np.take_along_axis(units.T, self.lists.astype(np.int64), axis=1)


def read_blocks(t: pa.Table) -> list[Block]:
    """The blocks of a cell, longest first."""
    found = []
    for dim, longest, ids, labels, vectors, lists in zip(*(t.column(c).to_pylist() for c in ("dim", "longest", "ids", "labels", "vectors", "lists"))):
        i = np.frombuffer(ids, "<i8")
        found.append(Block(i, np.frombuffer(labels, "<i8"), np.frombuffer(vectors, "<i4").reshape(len(i), dim), np.frombuffer(lists, "<u2").reshape(dim, len(i)), longest))
    return sorted(found, key=lambda b: (-b.longest, int(b.ids[0])))


class Anchor:
    def __init__(self, vector: np.ndarray):
        self.vector, self.numbers = vector.astype(np.int64), vector.astype(float)
        self.norm = float(np.sqrt((self.numbers**2).sum()))
        unit = self.numbers / (self.norm or 1.0)
        self.focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        self.angles = np.arccos(np.clip(unit[self.focus], -1, 1))

    def candidates(self, block: Block, least: float) -> np.ndarray | None:
        """Places of rows that may score `least` or more, in no order; None for all rows."""
        if least <= 0:
            return None
        most = self.norm * block.longest
        if least > most * (1 + SLACK):
            return np.zeros(0, np.int64)
        turn = np.arccos(min(1.0, least / most)) + 1e-7  # rounding moves an angle near 0 by so much
        low, high = np.cos(np.minimum(np.pi, self.angles + turn)) - SLACK, np.cos(np.maximum(0, self.angles - turn)) + SLACK
        n = len(block.ids)
        hits, used = np.zeros(n, np.uint8), 0
        for f, lo, hi in zip(self.focus.tolist(), low, high):
            if f >= len(block.sorted):  # all rows have 0 there
                if lo > 0 or hi < 0:
                    return np.zeros(0, np.int64)
                continue
            a, b = np.searchsorted(block.sorted[f], lo), np.searchsorted(block.sorted[f], hi, "right")
            if b - a < n:
                hits[block.lists[f, a:b]] += 1
                used += 1
        return np.flatnonzero(hits == used) if used else None

    def scores(self, block: Block, places: np.ndarray | None) -> np.ndarray:
        """Inner products, in whole numbers."""
        d = min(len(self.vector), block.vectors.shape[1])
        exact = self.norm * block.longest < EXACT
        own = (block.numbers if exact else block.vectors.astype(np.int64))[:, :d]
        return np.asarray((own if places is None else own[places]) @ (self.numbers if exact else self.vector)[:d]).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:most]
    return scores[order], ids[order]


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def nearest_cell(most: int):
    """The best `most` rows of an anchor's own label in the blocks of a cell."""

    def run(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        held = read_blocks(blocks) if anchors.num_rows else []
        for q, vec_id, label, vector in zip(*(anchors.column(c).to_pylist() for c in ("q", "vec_id", "label", "vector"))) if held else ():
            anchor, best = Anchor(np.array(vector, np.int64)), _NONE
            for block in held:
                least = float(best[0][-1]) if len(best[0]) == most else 0.0
                places = anchor.candidates(block, least)
                ids = block.ids if places is None else block.ids[places]
                labels = block.labels if places is None else block.labels[places]
                own = (labels == label) & (ids != vec_id)
                if own.any():
                    places = np.flatnonzero(own) if places is None else places[own]
                    best = _best(np.append(best[0], anchor.scores(block, places)), np.append(best[1], ids[own]), most)
            out += [(q, int(i), int(s)) for s, i in zip(*best)]
        return pa.table({k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(("q", "positive_id", "positive_score"))})

    return run


def negatives_cell(most: int, floor: int):
    """For each positive of an anchor the best `most` rows of other labels that score no more than it and `floor` percent of it or more."""

    def run(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[tuple] = []
        held = read_blocks(blocks) if anchors.num_rows else []
        for q, label, vector, positives in zip(*(anchors.column(c).to_pylist() for c in ("q", "label", "vector", "positives"))) if held else ():
            anchor = Anchor(np.array(vector, np.int64))
            wanted = [(k, p["positive_score"]) for k, p in enumerate(positives) if p["positive_score"] >= 0]  # below 0 nothing fits
            found = {k: _NONE for k, _ in wanted}
            for block in held if wanted else ():
                # what a row must reach to count for any of the positives
                least = min(max(floor * p / 100, found[k][0][-1] if len(found[k][0]) == most else 0) for k, p in wanted)
                places = anchor.candidates(block, float(least))
                ids = block.ids if places is None else block.ids[places]
                other = (block.labels if places is None else block.labels[places]) != label
                if not other.any():
                    continue
                ids, places = ids[other], np.flatnonzero(other) if places is None else places[other]
                scores = anchor.scores(block, places)
                near = scores >= least
                scores, ids = scores[near], ids[near]
                order = np.lexsort((ids, -scores))
                scores, ids = scores[order], ids[order]
                for k, p in wanted:
                    a = int(np.searchsorted(-scores, -p))
                    b = min(a + most, int(np.searchsorted(-scores, -floor * p // 100, "right")))
                    if a < b:
                        found[k] = _best(np.append(found[k][0], scores[a:b]), np.append(found[k][1], ids[a:b]), most)
            out += [(q, k, int(i), int(s)) for k, _ in wanted for s, i in zip(*found[k])]
        return pa.table({k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(("q", "k", "negative_id", "negative_score"))})

    return run


def _dealt(anchors: DataFrame, lanes: Column, rows: int) -> DataFrame:
    """Anchors once for every lane; `row` splits them where they are many."""
    return anchors.withColumn("row", F.pmod("q", F.lit(rows)).cast("int")).withColumn("lane", F.explode(F.sequence(F.lit(0), lanes - 1)))


def _spread(blocks: DataFrame, lanes: Column, rows: int) -> DataFrame:
    """Blocks in their lane, once for every row of anchors."""
    return blocks.withColumn("lane", F.pmod(F.xxhash64("block"), lanes).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))


def hard_negatives(rows: DataFrame, anchors: Column, *, scale: int = SCALE, positives: int = 5, negatives: int = 5, floor: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows (vec_id, embedding, label) that `anchors` picks.

    Scores are inner products of floor(scale * component); higher ones come first, ties by smaller vec_id. An anchor's positives are the
    first `positives` rows of its label with another vec_id. Its negatives for a positive are the first `negatives` rows of other labels
    that score at most as the positive and `floor` percent of it at least; none where the positive scores below 0.

    Rows with a null vec_id, label, vector or component, and those with a component that is not finite, take no part. Repeated rows are rows of
    their own, as anchors and as results; none is a positive of a row with its own vec_id. Vectors of different lengths meet as if the shorter ended in
    zeros; an empty or zero vector scores 0 with all. Scaled components beyond 2^25 either way count as 2^25. Extra columns are not
    read, an empty table gives an empty result.
    """
    known = usable(rows, scale=scale)
    tasks = max(1, -(-known.count() // TASK_ROWS))  # few where there are few rows, so that blocks are not tiny
    blocks = staged(blocks_of(known.coalesce(tasks)), "blocks")
    picked = staged(known.where(anchors).withColumn("q", F.monotonically_increasing_id()), "anchors")
    n_anchors = picked.count()
    sizes = {r["label_group"]: r["count"] for r in blocks.groupBy("label_group").count().collect()}  # LABEL_GROUPS rows at most
    grid_rows = max(1, -(-n_anchors // CELL_ANCHORS))
    group = F.pmod("label", F.lit(LABEL_GROUPS)).cast("int")
    lanes_of = F.array(*[F.lit(-(-sizes.get(g, 1) // CELL_BLOCKS)) for g in range(LABEL_GROUPS)])
    cell = ["label_group", "lane", "row"]
    left = _dealt(picked.withColumn("label_group", group), F.get(lanes_of, F.col("label_group")), grid_rows)
    right = _spread(blocks, F.get(lanes_of, F.col("label_group")), grid_rows)
    near = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(nearest_cell(positives), "q long, positive_id long, positive_score long")
    order = Window.partitionBy("q").orderBy(F.col("positive_score").desc(), "positive_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    listed = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    paired = staged(picked.join(listed, "q"), "positives")

    lanes = F.lit(max(1, -(-sum(sizes.values()) // CELL_BLOCKS)))
    cell = ["lane", "row"]
    far = _dealt(paired, lanes, grid_rows).groupBy(*cell).cogroup(_spread(blocks, lanes, grid_rows).groupBy(*cell))
    far = far.applyInArrow(negatives_cell(negatives, floor), "q long, k long, negative_id long, negative_score long")
    order = Window.partitionBy("q", "k").orderBy(F.col("negative_score").desc(), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = paired.select("q", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("k", "p"))
    named = named.select("q", F.col("k").cast("long").alias("k"), "anchor_id", "p.positive_id", "p.positive_score")
    return far.join(named, ["q", "k"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {"op11_hard_negatives": OP11_SQL}
