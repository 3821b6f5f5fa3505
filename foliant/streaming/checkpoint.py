"""Append log of results: last write wins, reuse by key and fingerprint; as a batch table or a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(key, result, seq) of a log with one JSON object a line; blank, torn and foreign lines fall away."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("seq"))
    return parse_log(lines)


def parse_log(lines: DataFrame) -> DataFrame:
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    key, result = F.try_variant_get("v", "$.chunk_id", "string"), F.try_variant_get("v", "$.result", "variant")
    whole = F.schema_of_variant(F.try_variant_get("v", "$.chunk_id", "variant")) == "STRING"
    return parsed.where(whole & F.schema_of_variant(result).startswith("OBJECT")).select(key.alias("key"), result.cast("string").alias("result"), "seq")


def last_writes(log: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The latest value of each key; partial maxima before the shuffle, so a hot key sends one row a task."""
    return log.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def reuse(wanted: DataFrame, log: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with the stored result, misses): a hit needs the key and an equal fingerprint."""
    on = [*keys, "fingerprint"]
    return wanted.join(log, on), wanted.join(log, on, "left_anti")


def append(results: DataFrame, path: str) -> None:
    results.write.mode("append").parquet(path)


def stream_last_writes(spark: SparkSession, folder: str, schema: str, keys: list[str], order: str, value: str) -> DataFrame:
    """The same view over a growing folder of Parquet files, for output mode complete or update."""
    return spark.readStream.schema(schema).parquet(folder).groupBy(*keys).agg(F.max_by(value, order).alias(value))
