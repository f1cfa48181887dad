"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of N slots. Slot n is the point n * q mod N of a golden-ratio lattice (q is
the whole number nearest N / phi that shares no factor with N), so every stretch of slots covers the
line evenly and every point is hit once. The line is cut by the sources' cumulative weights: the
point's place names the slot's source. Slots are ranked within their source, and rank r takes block
r mod n_blocks of it. A source's blocks are equal numbers of words of its documents in shuffled order.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import chunk_count, running_start, staged, table, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 64
SLOT_CHUNK = 1 << 16


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> with place (1 up, by code point, null last), weight and target (double).

    Targets share the sum of all sizes by weight; none is above max_epochs times its source, and
    what is above goes to the others by weight. In the order of cap over weight, the sources before
    the first that is below its cap are the capped ones. One row a source: the windows over all
    rows see only that list.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap = max_epochs * F.col("source_size")
    listed = sizes.withColumn("place", F.row_number().over(by_name))
    listed = listed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("ratio"), "place").rowsBetween(Window.unboundedPreceding, -1)
    leveled = (
        listed.withColumn("ratio", cap / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(by_ratio), F.lit(0)))
        .withColumn("share", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("share"))
    )
    open_level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(every)
    target = F.least(cap.cast("double"), F.coalesce(open_level["level"], F.lit(float("inf"))) * F.col("weight"))
    return leveled.select("source", "source_size", "place", "weight", target.alias("target"))


def lattice_step(n: int) -> int:
    """The whole number nearest n / phi without a common factor with n."""
    near = max(1, round(n * 0.6180339887498949))
    return next(q for d in range(n + 1) for q in (near + d, near - d) if q > 0 and gcd(q, n) == 1)


def schedule(sources: DataFrame, n_slots: int, *, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """slot, place, rank, block, epoch for the slots of the mix. `sources`: place, first, last (on the line), n_blocks."""
    spark = sources.sparkSession
    step, cell = lattice_step(n_slots), -(-n_slots // 1024)
    n = F.col("slot")
    # the product needs more than 63 bits only beyond 2^31 slots
    wide: Column = n if n_slots < 1 << 31 else n.cast("decimal(20,0)")
    point = ((wide * F.lit(step)) % F.lit(n_slots)).cast("long")
    slots = spark.range(n_slots).select(F.col("id").alias("slot")).withColumn("point", point)
    slots = slots.withColumn("cell", F.floor(F.col("point") / cell))
    on_line = sources.where("last > first").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor((F.col("last") - 1) / cell)))
    )
    named = (
        slots.join(on_line, "cell")
        .where((F.col("point") >= F.col("first")) & (F.col("point") < F.col("last")))
        .select("slot", "place", "n_blocks", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"), F.lit(1).alias("one"))
    )
    ranked = running_start(staged(named, "slots"), "place", "chunk", ["slot"], "one", "rank")
    return ranked.where(F.col("rank") < max_epochs * F.col("n_blocks")).select(
        "slot", "place", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"), F.floor(F.col("rank") / F.col("n_blocks")).alias("epoch")
    )


def mix(docs: DataFrame, *, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS) -> dict[str, DataFrame]:
    """The mix of `docs` (doc_id, text, source): {"documents", "sources", "pieces"}.

    documents: doc_id, source, text_hash, size, source_size, target, taken, one row for every input row;
    sources: the targets; pieces: slot, place, start, words - the words each slot takes, as a stretch
    of its source's shuffled line. Null text has size 0 and is never taken; a null source is a source,
    the last one. Repeated rows are rows of their own. A source's slots are within one of
    target / block size, and a slot beyond max_epochs passes is left out, so no document is taken more
    than max_epochs times. Empty tables, and tables without words, give no pieces and targets of 0.
    """
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))
    rows = staged(sized, "sizes")
    targets = staged(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, max_epochs=max_epochs), "targets")
    n_blocks = F.greatest(F.lit(1), F.round(F.col("source_size") / block_words)).cast("long")
    cut = F.round(F.sum(F.col("wanted")).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))).cast("long")
    on_line = (
        targets.where("source_size > 0")
        .withColumn("n_blocks", n_blocks)
        .withColumn("wanted", F.col("target") * F.col("n_blocks") / F.col("source_size"))
        .withColumn("last", cut)
        .withColumn("first", F.coalesce(F.lag("last").over(Window.orderBy("place")), F.lit(0)))
    )
    on_line = staged(on_line, "line")
    n_slots = on_line.agg(F.max("last")).first()[0] or 0
    n_rows = rows.count()

    shuffled = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    shuffled = shuffled.withColumn("order", F.xxhash64(F.lit("mix"), "doc_id", "text_hash"))  # a repeated or null id is no hot chunk
    shuffled = shuffled.withColumn("chunk", F.pmod("order", F.lit(chunk_count(n_rows))))
    lined = running_start(shuffled, "place", "chunk", ["order", "doc_id", "text_hash", "size"], "size", "start")
    lined = staged(lined, "lines")
    block_of = lambda c: F.least(F.floor(c / block_words), F.col("n_blocks") - 1)
    end = F.col("start") + F.col("size")
    in_blocks = (
        lined.where("size > 0")
        .join(on_line.select("place", "n_blocks"), "place")
        .withColumn("block", F.explode(F.sequence(block_of(F.col("start")), block_of(end - 1))))
        .withColumn("from", F.greatest("start", F.col("block") * block_words))
        .withColumn("to", F.when(F.col("block") == F.col("n_blocks") - 1, end).otherwise(F.least(end, (F.col("block") + 1) * block_words)))
        .select("place", "block", "start", "from", (F.col("to") - F.col("from")).alias("words"))
    )
    slots = schedule(on_line, n_slots, max_epochs=max_epochs) if n_slots else None
    if slots is None:
        pieces = in_blocks.select(F.lit(0).cast("long").alias("slot"), "place", "start", "from", "words").where("false")
    else:
        pieces = slots.join(in_blocks, ["place", "block"]).select("slot", "place", "start", "from", "words")
    taken = pieces.groupBy("place", "start").agg(F.sum("words").alias("taken"))
    taken = lined.where("size > 0").join(taken, ["place", "start"], "left").unionByName(
        lined.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    )
    documents = taken.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
    return {"documents": documents, "sources": targets, "pieces": pieces}


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """`docs` with every row as often as the mix takes it (taken over size, rounded); rows taken less than half are left out.

    All columns stay, whatever their names. Of whole rows that repeat each gets the mean of what they are taken."""
    counts = mix(docs, **options)["documents"].groupBy("doc_id", "text_hash").agg(F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("times"))
    counts = staged(counts.where("times > 0"), "copies-taken")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    joined = rows.join(counts, rows["id"].eqNullSafe(counts["doc_id"]) & (rows["hash"] == counts["text_hash"]))
    return joined.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def op3_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))["documents"].select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_mixing": op3_mixing}
ORACLES: dict[str, str] = {}
