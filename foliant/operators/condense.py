"""Estimates of the stages around the text provider, without asking it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliant.functions.cost import SYNTHESIS_SHAVE, TRIM_SHAVE, target_tokens

UNDERSHOOT = 0.75
TRIM_OVER = 1.15


def extract(text: Column, ratio: float) -> Column:
    """The default provider: the first words of a text, rounded half to even, one at least."""
    words = F.split(text, " ")
    return F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), F.rint(F.size(words).cast("double") * ratio).cast("int"))), " ")


def serialize_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One body per run, each block under a header with its ordinal and type."""
    n = F.row_number().over(W.partitionBy(*keys, "run_id").orderBy("block_index"))
    line = F.concat(F.lit("[BLOCK "), n.cast("string"), F.lit(" type="), "type", F.lit("]\n"), "text")
    lines = runs.where("run_id is not null").withColumn("line", line)
    return lines.groupBy(*keys, "run_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block_index", "line")))["line"], "\n").alias("body"))


def undershoots(report: DataFrame, target: float) -> DataFrame:
    """Rows that kept something, but under three quarters of the target."""
    return report.where((F.col("kept_ratio") > 0) & (F.col("kept_ratio") < target * UNDERSHOOT))


def synthesize(condensed: DataFrame, ratio: float) -> DataFrame:
    """Per chapter: smoothed unless it is one chunk within budget, then trimmed once if still over by more than 15 %.

    The passes are unrolled; the default provider shortens by fixed shares.
    """
    c = condensed.groupBy("chapter").agg(F.sum("tokens").alias("input_tokens"), F.sum("out_tokens").alias("o"), F.max("chunk_no").alias("chunks"))
    c = c.withColumn("target_tokens", target_tokens(F.col("input_tokens"), ratio))
    c = c.withColumn("smoothed", ~((F.col("chunks") == 1) & (F.col("o") <= F.col("target_tokens"))))
    c = c.withColumn("s", F.when(F.col("smoothed"), F.rint(F.col("o").cast("double") * SYNTHESIS_SHAVE).cast("long")).otherwise(F.col("o")))
    c = c.withColumn("trim_passes", (F.col("smoothed") & (F.col("s") > F.col("target_tokens") * TRIM_OVER)).cast("int"))
    return c.withColumn("output_tokens", F.when(F.col("trim_passes") == 1, F.rint(F.col("s").cast("double") * TRIM_SHAVE).cast("long")).otherwise(F.col("s")))
