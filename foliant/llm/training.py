"""Bounded samples of labelled documents, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.workspace import small_batches

FOLDS = 5
#: Distinct labels that a model is fitted to, which bounds the sample with `most` rows of each.
MOST_LABELS = 64


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the folds; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int = 1) -> list[tuple[int, str, str, float]]:
    """(doc_id, lang, text, label) of at most about `most` documents of each label outside fold 0.

    Which rows are taken depends on a hash of the id alone. A document with several labels has the largest.
    Ids without a label, text or document are left out.
    """
    small_batches(docs.sparkSession)
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"{label} has over {MOST_LABELS} values; grades are few")
    if not counts:
        return []
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, most / n))).otherwise(share)
    picked = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20))
    # At most about `most` ids for each of at most MOST_LABELS labels: small enough to broadcast by construction.
    rows = docs.select("doc_id", "lang" if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"), "text").where("text is not null")
    found = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "lang", "text", "label").collect()
    return sorted({r["doc_id"]: (r["doc_id"], r["lang"], r["text"], r["label"]) for r in sorted(found, key=lambda r: (r["doc_id"], r["text"]))}.values())
