"""Links within a book: where their targets are in the output, and how they are written there."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

ANCHORED = ("heading", "paragraph", "quote", "list")
TOKEN = re.compile(r'(<a href="[^"]*">|</a>)')


def anchor_locations(blocks: DataFrame, book: list[str], chapter_no: str = "chapter_no") -> DataFrame:
    """(book, anchor_id, chapter_no): the first chapter, from 1, whose text still holds the anchor."""
    held = blocks.where(F.col("type").isin(*ANCHORED) & F.col("anchor_id").isNotNull())
    return held.groupBy(*book, "anchor_id").agg(F.min(chapter_no).alias("chapter_no"))


def targets(rich: Column) -> Column:
    """Anchors that a text points at."""
    return F.array_distinct(F.regexp_extract_all(rich, F.lit(r'<a href="bbref:([^"]+)">'), 1))


def rewrite(rich: str, hrefs: dict[str, str]) -> str:
    """Markup with links to anchors written as their href, and those without one taken off their text."""
    out, ends = [], []
    for part in TOKEN.split(rich):
        if part == "</a>":
            part = ends.pop() if ends else part
        elif part.startswith('<a href="'):
            target = part[9:-2]
            known = hrefs.get(target.removeprefix("bbref:")) if target.startswith("bbref:") else target
            ends.append("" if known is None else "</a>")
            part = "" if known is None else f'<a href="{known}">'
        out.append(part)
    return "".join(out)


@F.pandas_udf(T.StringType())
def _rewritten(rich: pd.Series, names: pd.Series, hrefs: pd.Series) -> pd.Series:
    pairs = zip(rich, names, hrefs)
    return pd.Series([None if r is None else rewrite(r, dict(zip(n, h)) if n is not None else {}) for r, n, h in pairs], dtype=object)


def href(chapter_no: Column, own: Column, anchor: Column) -> Column:
    """A target's address in a file per chapter."""
    place = F.concat(F.lit("#"), anchor)
    return F.when(chapter_no == own, place).when(chapter_no.isNotNull(), F.concat(F.lit("chap-"), chapter_no.cast("string"), F.lit(".xhtml"), place))


def linked(blocks: DataFrame, book: list[str], locations: DataFrame, one_file: bool = False) -> DataFrame:
    """blocks (book, chapter_no, block_index, rich, items_rich) with links rewritten; one_file: all in one document."""
    keys = [*book, "chapter_no", "block_index"]
    places = F.concat(F.coalesce(targets(F.col("rich")), F.array().cast("array<string>")), F.flatten(F.transform(F.coalesce("items_rich", F.array().cast("array<string>")), targets)))
    wanted = blocks.select(*keys, F.explode(F.array_distinct(places)).alias("anchor_id"))
    at = locations.withColumnRenamed("chapter_no", "at")
    written = F.when(F.col("at").isNotNull(), F.concat(F.lit("#"), "anchor_id")) if one_file else href(F.col("at"), F.col("chapter_no"), F.col("anchor_id"))
    found = wanted.join(at, [*book, "anchor_id"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("anchor_id", written.alias("href")))).alias("_links"))
    held = blocks.join(found, keys, "left")
    names, hrefs = F.col("_links.anchor_id"), F.col("_links.href")
    # Only texts with links go through Python; list items are rewritten as one text.
    has = F.contains("rich", F.lit('href="bbref:'))
    items = F.array_join("items_rich", "\x1e")
    items_have = F.contains(items, F.lit('href="bbref:'))
    rich = F.when(has, _rewritten(F.when(has, F.col("rich")), names, hrefs)).otherwise(F.col("rich"))
    items_rich = F.when(items_have, F.split(_rewritten(F.when(items_have, items), names, hrefs), "\x1e")).otherwise(F.col("items_rich"))
    return held.withColumn("rich", rich).withColumn("items_rich", items_rich).drop("_links").select(blocks.columns)


def unresolved(rich: Column) -> Column:
    """A text whose links to anchors are all taken off."""
    return _rewritten(rich, F.array().cast("array<string>"), F.array().cast("array<string>"))


def chapter_numbers(chapters: DataFrame, book: list[str], chapter: str) -> DataFrame:
    """(book, chapter, chapter_no) from 1 in order. A book's chapters are few; books are many."""
    return chapters.select(*book, chapter).distinct().withColumn("chapter_no", F.row_number().over(W.partitionBy(*book).orderBy(chapter)))
