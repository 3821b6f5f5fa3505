"""Blocks, budgets, chunks and runs: the relational core around the text provider.

A block row is (book, chapter, block_index, type, text, ...). Order is data: every operator sorts by index columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliant.functions.text import count_tokens, lines_of, strip

PROSE = ("paragraph", "quote", "list")
TEXTS = ("heading", "paragraph", "quote")


def paragraphs(docs: DataFrame) -> DataFrame:
    """One paragraph block per line with text; each document is a chapter of the book named by its source."""
    rows = docs.select(F.col("source").alias("book"), F.col("doc_id").alias("chapter"), F.posexplode(lines_of(F.col("text"))).alias("block_index", "text"))
    return rows.withColumn("type", F.lit("paragraph")).withColumn("tokens", count_tokens(F.col("text")))


def chunk_numbers(tokens: Column, most: int) -> Column:
    """For an array of token counts, the chunk of each: a new one starts where the current has blocks and would overflow.

    The fold is sequential and its state must stay small for it to be linear, so it runs over Arrow batches.
    """

    @F.pandas_udf("array<int>")
    def run(held: pd.Series) -> pd.Series:
        return pd.Series([None if counts is None else _chunk_numbers(counts, most) for counts in held], dtype=object)

    return run(tokens.cast("array<long>"))


def _chunk_numbers(counts, most: int) -> list[int]:
    out, chunk, load, blocks = [], 1, 0, 0
    for n in counts.tolist():
        if blocks and load + n > most:
            chunk, load, blocks = chunk + 1, 0, 0
        load, blocks = load + n, blocks + 1
        out.append(chunk)
    return out


def chunked(docs: DataFrame, most: int = 500) -> DataFrame:
    """Paragraph blocks with chunk_no. A chapter is one row, so chunking runs inside the scan, without a shuffle."""
    lines = docs.select(F.col("source").alias("book"), F.col("doc_id").alias("chapter"), lines_of(F.col("text")).alias("lines"))
    counted = lines.withColumn("tokens", F.transform("lines", count_tokens))
    zipped = counted.withColumn("chunks", chunk_numbers(F.col("tokens"), most)).select("book", "chapter", F.posexplode(F.arrays_zip("lines", "tokens", "chunks")).alias("block_index", "z"))
    return zipped.select("book", "chapter", "block_index", F.col("z.chunks").alias("chunk_no"), F.col("z.lines").alias("text"), F.col("z.tokens").alias("tokens"))


def chunk_table(blocks: DataFrame, chapter: list[str], most: int) -> DataFrame:
    """chunk_no for blocks that lie in rows of their own, by chapter; needs (block_index, tokens)."""
    held = blocks.groupBy(*chapter).agg(F.array_sort(F.collect_list(F.struct("block_index", "tokens"))).alias("b"))
    chunks = chunk_numbers(F.transform("b", lambda x: x.tokens), most)
    return held.select(*chapter, F.explode(F.arrays_zip(F.col("b.block_index").alias("i"), chunks.alias("c"))).alias("z")).select(*chapter, F.col("z.i").alias("block_index"), F.col("z.c").alias("chunk_no"))


def previous_context(chunks: DataFrame, tail: int = 400) -> DataFrame:
    """For each chunk the end of the last text that isn't blank in the chunk before it."""
    last = chunks.groupBy("book", "chapter", "chunk_no").agg(F.max(F.when(F.trim("text") != "", F.struct("block_index", "text")))["text"].alias("last"))
    w = W.partitionBy("book", "chapter").orderBy("chunk_no")
    return last.select("book", "chapter", "chunk_no", F.right(strip(F.lag("last").over(w)), F.lit(tail)).alias("prev_context"))


def runs(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """kind (text, keep, image) and run_id: consecutive prose blocks share one, counted from 1; others have none."""
    w = W.partitionBy(*keys).orderBy("block_index")
    prose = F.col("type").isin(*PROSE)
    kind = F.when(prose, "text").when(F.col("type") == "image", "image").otherwise("keep")
    starts = (prose & ~F.coalesce(F.lag(prose).over(w), F.lit(False))).cast("int")
    return blocks.withColumn("kind", kind).withColumn("_start", starts).withColumn("run_id", F.when(prose, F.sum("_start").over(w)).cast("int")).drop("_start")


def nearest_text(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest heading, paragraph or quote before and after each block; an empty one counts as nearest."""
    w = W.partitionBy(*keys).orderBy("block_index")
    text = F.when(F.col("type").isin(*TEXTS), F.col("text"))
    return blocks.withColumn("before", F.last(text, True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("after", F.first(text, True).over(w.rowsBetween(1, W.unboundedFollowing)))


def unit_batches(units: DataFrame, keys: list[str], order: str, size: int = 40) -> DataFrame:
    """Units numbered from 0 within keys, in batches that start at multiples of size."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    return units.withColumn("unit", n).withColumn("batch_start", (F.floor(F.col("unit") / size) * size).cast("int"))


def toc_intervals(toc: DataFrame) -> DataFrame:
    """Entries (doc, ord, title, start_page) with the page before which each ends; null for the last."""
    return toc.withColumn("end_page", F.lead("start_page").over(W.partitionBy("doc").orderBy("start_page", "ord")))


def pages_to_chapters(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """Interval join; pages before the first entry drop out, an entry that shares its start with the next stays empty."""
    t = toc_intervals(toc)
    return pages.join(t, (pages.doc == t.doc) & (pages.page >= t.start_page) & (t.end_page.isNull() | (pages.page < t.end_page))).select(pages["*"], t.ord, t.title)


def outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines whose middle lies in no table of their page. The join is by page; the range is its residual condition."""
    mid = (lines.top + lines.bottom) / 2
    return lines.join(tables, (lines.doc == tables.doc) & (lines.page == tables.page) & mid.between(tables.top, tables.bottom), "left_anti")


# Parts of the names of fonts whose letters are equally wide.
MONO = ("mono", "courier", "consol", "menlo", "andale")


def classify_lines(lines: DataFrame) -> DataFrame:
    """code, heading or body, by font and size against the median size of the book's own text, 11 if it has none."""
    mono = F.lower("font").rlike("|".join(MONO))
    bold = F.lower("font").contains("bold")
    body = lines.groupBy("doc").agg(F.coalesce(F.median(F.when(~mono & (F.col("size") > 0), F.col("size"))), F.lit(11.0)).alias("body"))
    kind = F.when(mono, "code").when((F.col("size") >= 1.25 * F.col("body")) | (bold & (F.col("size") >= 1.05 * F.col("body"))), "heading").otherwise("body")
    return lines.join(body, "doc").withColumn("kind", kind)


def line_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of classified lines: headings alone, code by line, paragraphs split where a gap exceeds 0.6 of the median height."""
    page = W.partitionBy("doc", "page")
    w = page.orderBy("top", "line_no")
    gap = F.col("top") - F.lag("bottom").over(w)
    height = F.median(F.col("bottom") - F.col("top")).over(page)
    new = (F.col("kind") == "heading") | (F.lag("kind").over(w).isNull()) | (F.lag("kind").over(w) != F.col("kind")) | ((F.col("kind") == "body") & (gap > 0.6 * height))
    marked = lines.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w).cast("int"))
    held = marked.groupBy("doc", "page", "island").agg(F.first("kind").alias("kind"), F.max(F.col("size") / F.col("body")).alias("scale"), F.array_sort(F.collect_list(F.struct("top", "line_no", "text"))).alias("t"))
    texts = F.col("t.text")
    return held.select(
        "doc", "page", "island", F.get("t.top", F.lit(0)).alias("top"), F.when(F.col("kind") == "body", "paragraph").otherwise(F.col("kind")).alias("type"),
        F.when(F.col("kind") == "heading", F.when(F.col("scale") >= 1.6, 1).otherwise(2)).alias("level"),
        F.when(F.col("kind") == "code", F.array_join(texts, "\n")).otherwise(F.array_join(texts, " ")).alias("text"),
    )


def page_blocks(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks of pages (doc, page, part, top, seq, type, level, text, rows): lines outside tables, and the tables.

    Within a page they go by their top, tables first where tops are equal.
    """
    text = line_blocks(outside_tables(classify_lines(lines).where("text != ''"), tables))
    text = text.select("doc", "page", F.lit(1).alias("part"), F.col("top").cast("double").alias("top"), (F.col("island") + (1 << 20)).alias("seq"), "type", "level", "text")
    n = F.row_number().over(W.partitionBy("doc", "page").orderBy("top", "bottom")).cast("int")
    whole = tables.select("doc", "page", F.lit(1).alias("part"), F.col("top").cast("double").alias("top"), n.alias("seq"), F.lit("table").alias("type"), "rows")
    return text.unionByName(whole, allowMissingColumns=True)


def numbered_blocks(blocks: DataFrame, chapter: list[str], order: list[str]) -> DataFrame:
    """blocks with block_index from 0 within their chapter, without the columns that told their order."""
    n = F.row_number().over(W.partitionBy(*chapter).orderBy(*order)) - 1
    return blocks.withColumn("block_index", n.cast("int")).drop(*order)


def first_of_content(images: DataFrame) -> DataFrame:
    """The first image of each content in reading order (doc, chapter, page, pos); its id is made from the content."""
    w = W.partitionBy("doc", "content").orderBy("chapter", "page", "pos")
    hashed = images.withColumn("content", F.sha2("data", 256))
    return hashed.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc", "chapter", "page", "pos", F.concat(F.lit("pdfimg-"), F.substring("content", 1, 16)).alias("image_id"))


def select_assets(assets: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept assets, dropped assets, dangling references), all by (doc, image_id)."""
    keys = ["doc", "image_id"]
    return assets.join(references, keys, "left_semi"), assets.join(references, keys, "left_anti"), references.join(assets, keys, "left_anti")
