"""Corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm import near, ordinal, packing, suffix, toxicity
from foliant.workspace import Workspace


#: A passage of 50 words, which the corpus shall not hold twice, at four letters and a space a word. (op4's contract
#: has strings of 400 bytes, some 67 words of these texts; its query keeps to that.)
PASSAGE_BYTES = 250


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the classifier doesn't reject, with their columns. Null is the empty text; without a lang column one limit
    holds for all, and without labels nothing is learnt. Repeated rows are judged alike, an empty table stays empty."""
    model = spark.sparkContext.broadcast(toxicity.fit(docs, _labels(spark, sf_dir)))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.where(~toxicity.rejection(model)(F.col("text"), lang)).select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose top grade is likely by a half or more; one at a half stays. Without two grades among the labels all stay.
    Null is the empty text, repeated rows are judged alike, an empty table stays empty."""
    fitted = ordinal.fit(docs, _labels(spark, sf_dir))
    if not len(fitted.thresholds):
        return docs
    return docs.where(ordinal.tail(spark.sparkContext.broadcast(fitted))(F.col("text")) >= 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least doc_id; of repeated rows one. Null is the empty text,
    and empty texts are copies. Rows without a doc_id all stay."""
    return near.without_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All docs, without what stands elsewhere too in strings of PASSAGE_BYTES; n_chars is as it was. Null stays null, a
    character that is cut through goes, and equal texts of that size, so also repeated rows, lose all of it."""
    return suffix.without_repeats(docs, window=PASSAGE_BYTES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document. Null is the empty text, which is one closing id; repeated rows are packed each."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]
#: Trained models, sampled signatures and byte-level packing have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed documents after all stages, each written and read again. Nulls, empty and very long texts, ties, repeated
    rows and further columns go through as the stages say; an empty table gives an empty result."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
