"""SimHash near-dedup with pivot distance tables.

A fingerprint is split into `max_bits` + 2 segments. For every segment a table holds the Hamming
distances to many reference fingerprints (pivots). Fingerprints that differ in at most
`max_bits` bits agree on at least two whole segments, so they have equal table rows there:
candidates meet on the table rows of two segments. A candidate pair is discarded
when any full-width pivot distance differs by more than `max_bits` (triangle inequality), and
what survives is verified bit by bit.

Equal fingerprints are one node. Where more than `pair_limit` fingerprints share two segments,
their pairs are not formed: each is sent to the 65 fingerprints within one bit of it, and those
that meet there are within two bits of each other. This is exact and linear, so no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .base import components, staged, table

SEED = 42
N_PIVOTS = 24
MAX_BITS = 2
BLOCK = 1 << 14


def fingerprint(raw: bytes, words_per_shingle: int = 3) -> int:
    """Signed 64-bit SimHash of UTF-8 text; 0 without words."""
    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_per_shingle:
        starts, ends = [0], [len(line)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end, last = np.cumsum(size + 1) - 1, words_per_shingle - 1
        starts, ends = (end - size)[:-last], end[last:]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):  # few hashes at a time are Python numbers
        hashes = [digest(line[a:b], SEED) for a, b in zip(map(int, starts[at : at + BLOCK]), map(int, ends[at : at + BLOCK]))]
        block = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    ones = np.packbits(2 * bits > len(starts), bitorder="little")
    return int(ones.view("<i8")[0])


@F.arrow_udf(LongType())
def fingerprints(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t or b"") for t in text.cast(pa.binary()).to_pylist()], pa.int64())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = N_PIVOTS) -> list[int]:
    return [xxhash.xxh64_intdigest(b"pivot %d" % k, SEED) for k in range(n)]


def _distances(fp: Column, mask: int = (1 << 64) - 1) -> Column:
    """One row of a pivot table: distances to every pivot under `mask`."""
    parts = [F.bit_count(fp.bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(p & mask)))) for p in pivots()]
    return F.array(*[p.cast("byte") for p in parts])


def links(prints: DataFrame, *, max_bits: int = MAX_BITS, pair_limit: int = 64) -> DataFrame:
    """Links (u, v) that join exactly the fingerprints within `max_bits` (at most 2) of each other; `prints` has distinct fp."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2")
    n = max_bits + 2
    edge = [64 * i // n for i in range(n + 1)]
    masks = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(n)]
    tables = prints.select("fp", *[_distances(F.col("fp"), m).alias(f"t{i}") for i, m in enumerate(masks)])
    keyed = tables.select(
        "fp",
        F.explode(
            F.array(*[F.xxhash64(F.lit(c), f"t{a}", f"t{b}") for c, (a, b) in enumerate(combinations(range(n), 2))])
        ).alias("cell"),
    )
    keyed = staged(keyed, "cells")
    sizes = keyed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(keyed.join(sizes, "cell"), "shared-cells")
    few = shared.where(F.col("n") <= pair_limit).select("cell", "fp")
    row = F.col
    left = few.select("cell", row("fp").alias("u"), _distances(row("fp")).alias("du"))
    right = few.select("cell", row("fp").alias("v"), _distances(row("fp")).alias("dv"))
    apart = F.array_max(F.zip_with("du", "dv", lambda a, b: F.abs(a.cast("int") - b.cast("int"))))
    close = (
        left.join(right, "cell")
        .where(row("u") < row("v"))
        .where(apart <= max_bits)
        .where(F.bit_count(row("u").bitwiseXOR(row("v"))) <= max_bits)
        .select("u", "v")
    )
    crowd = shared.where(F.col("n") > pair_limit).select("fp").distinct()
    return close.unionByName(_links_through_neighbours(crowd, max_bits)).distinct()


def _links_through_neighbours(prints: DataFrame, max_bits: int) -> DataFrame:
    """Stars that join what all pairs would. Within two bits are those that have a point within one bit in common;
    within one bit those that are equal with the same bit cleared."""
    bits = F.array(*[F.lit(_signed(1 << i)) for i in range(64)])
    at = prints.select("fp", F.explode(bits).alias("bit"))
    if max_bits == 2:
        at = at.select("fp", F.lit(0).cast("long").alias("bit"), F.col("fp").bitwiseXOR(F.col("bit")).alias("point"))
        at = at.unionByName(prints.select("fp", F.lit(0).cast("long").alias("bit"), F.col("fp").alias("point")))
    else:
        at = at.select("fp", "bit", F.col("fp").bitwiseAND(F.bitwise_not("bit")).alias("point"))
    hub = at.groupBy("point", "bit").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
    return at.join(hub, ["point", "bit"]).where("fp <> u").select("u", F.col("fp").alias("v"))


def near_groups(docs: DataFrame, *, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id reachable), kept: one row for every row of `docs`.

    Null text counts as empty; texts without words have fingerprint zero and are linked like any
    other. A null doc_id is never a component_id unless all of the component are null. One row of
    each component is kept: that of component_id, and of rows with this same doc_id the one with
    the smallest text hash (whole rows that repeat are left to exact dedup). Extra columns are
    not read; an empty table gives an empty result.
    """
    rows = staged(
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprints(F.col("text")).alias("fp")), "fingerprints"
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash"))
    prints = staged(rows.groupBy("fp").agg(first.alias("first")), "prints")
    linked = staged(links(prints.select("fp"), max_bits=max_bits), "links")
    roots = components(linked, "roots").withColumnsRenamed({"node": "fp"})
    known = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = known.groupBy("root").agg(F.min("first").alias("head"))
    answer = known.join(heads, "root").select("fp", "head")
    return rows.join(answer, "fp").select(
        "doc_id",
        "text_hash",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, *, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of `docs` that stay, one a component, with all their columns, whatever their names."""
    gone = staged(near_groups(docs, max_bits=max_bits).where(~F.col("kept")).select("doc_id", "text_hash"), "near-copies")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    same = rows["id"].eqNullSafe(gone["doc_id"]) & (rows["hash"] == gone["text_hash"])
    return rows.join(gone, same, "left_anti").select("row.*")


def op2_simhash(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}
