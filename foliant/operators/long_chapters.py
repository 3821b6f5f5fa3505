"""Greedy chunks of chapters of any size: no chapter is an array, a group or a task of its own.

Blocks lie end to end on a line, each as long as its tokens. A chunk that starts with block i ends before the block that
lies over the point `most` behind i's start, so every block has a pointer to where the next chunk would start. Which
pointers count is found by doubling: in each round, chunks reached so far lead on over twice as many. All steps are joins
by equality and sums over ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliant.operators.numbering import running
from foliant.workspace import Workspace


def next_starts(placed: DataFrame, chapter: list[str], most: int) -> DataFrame:
    """(chapter, i, to): where the next chunk starts if one starts with block i; blocks have i and their span [low, high).

    The block over a point is found by cells of about a block's length: a block is in each cell that it touches, and these
    are as many as blocks and cells together.
    """
    size = placed.agg((F.sum(F.col("high") - F.col("low")) / F.count("*")).alias("mean")).first()["mean"]
    width = max(1, round(size or 1))
    cell = lambda c: F.floor(F.col(c) / width)
    spans = placed.where("high > low").select(*chapter, F.col("i").alias("j"), "low", "high")
    spans = spans.select(*chapter, "j", "low", "high", F.explode(F.sequence(cell("low"), F.floor((F.col("high") - 1) / width))).alias("cell"))
    points = placed.select(*chapter, "i", (F.col("low") + most).alias("at")).withColumn("cell", cell("at"))
    over = points.join(spans, [*chapter, "cell"]).where("low <= at and at < high")
    return over.select(*chapter, "i", F.greatest("j", F.col("i") + 1).alias("to"))


def chunk_table(blocks: DataFrame, chapter: list[str], order: list[str], most: int) -> DataFrame:
    """blocks (chapter, order, tokens and whatever else) with chunk_no from 1.

    A new chunk starts where the current one has blocks and would exceed `most` tokens; blocks are never split, so a
    larger one is alone. Blocks of equal order follow each other in any order.
    """
    if most <= 0:
        raise ValueError("a chunk needs room for a token at least")
    work = Workspace(blocks.sparkSession, "long-chapters")
    placed = running(work, blocks.withColumn("_one", F.lit(1).cast("long")), chapter, order, _i="_one", _high="tokens")
    placed = work.put(placed.withColumns({"_i": F.col("_i") - 1, "_high": F.col("_high").cast("long")}), "placed")
    spans = placed.select(*chapter, F.col("_i").alias("i"), (F.col("_high") - F.coalesce("tokens", F.lit(0))).alias("low"), F.col("_high").alias("high"))
    # The chunk behind a last block that is larger than a chunk would start with nothing, so it isn't there.
    known = spans.select(*chapter, F.col("i").alias("to"))
    jumps = work.put(next_starts(spans, chapter, most).join(known, [*chapter, "to"], "left_semi"), "jumps")
    reached = new = work.put(spans.where("i = 0").select(*chapter, "i"), "reached")
    while not jumps.isEmpty():
        new = reached.join(jumps, [*chapter, "i"]).select(*chapter, F.col("to").alias("i"))
        reached = work.put(reached.union(new), "reached")
        onward = jumps.select(*chapter, F.col("i").alias("to"), F.col("to").alias("then"))
        jumps = work.put(jumps.join(onward, [*chapter, "to"]).select(*chapter, "i", F.col("then").alias("to")), "jumps")
    starts = reached.select(*chapter, F.col("i").alias("_i"), F.lit(1).cast("long").alias("_start"))
    marked = placed.join(starts, [*chapter, "_i"], "left").withColumn("_start", F.coalesce("_start", F.lit(0)))
    done = running(work, marked, chapter, ["_i"], chunk_no="_start")
    return done.withColumn("chunk_no", F.col("chunk_no").cast("int")).select(*blocks.columns, "chunk_no")
