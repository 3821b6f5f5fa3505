"""Which images stay: by reference, or by a provider's score of each image in its context."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions.provider import CALLS, Counted
from foliant.functions.text import fingerprint
from foliant.operators.blocks import nearest_text
from foliant.sources.html import block_image_ids

THRESHOLD, CONTEXT = 0.5, 600
PROMPT = (
    "Say whether this image earns its place in a shortened technical book: a diagram, chart, screenshot or formula that "
    'helps to understand does, decoration does not. Return only {"score": 0.0 to 1.0, "essential": true or false, "caption": "..."}.\n\nAround it:\n'
)


class Seeing(Protocol):
    def generate_with_image(self, user: str, image: bytes, mime: str) -> str: ...


def references(blocks: DataFrame, books: DataFrame, book: list[str]) -> DataFrame:
    """(book, image_id) of all images that blocks show, also inside their text, and of covers; books hold (book, cover)."""
    shown = blocks.select(*book, F.explode(block_image_ids()).alias("image_id"))
    covers = books.where("cover is not null").select(*book, F.col("cover").alias("image_id"))
    return shown.unionByName(covers).distinct()


def select(blocks: DataFrame, assets: DataFrame, books: DataFrame, book: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks without images that have no asset, assets that are shown, one row per book with sorted kept and dropped ids)."""
    on = [*book, "image_id"]
    shown = references(blocks, books, book)
    known = assets.select(*on).distinct()
    sound = blocks.where("type != 'image'").unionByName(blocks.where("type = 'image'").join(known, on, "left_semi").select(blocks.columns))
    marked = known.join(shown.withColumn("shown", F.lit(True)), on, "left")
    ids = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("image_id"))))
    report = marked.groupBy(*book).agg(ids(F.col("shown").isNotNull()).alias("kept"), ids(F.col("shown").isNull()).alias("dropped"))
    return sound, assets.join(shown, on, "left_semi"), report


def rankable(blocks: DataFrame, assets: DataFrame, book: list[str]) -> DataFrame:
    """Image blocks that have an asset."""
    return blocks.where("type = 'image'").join(assets.select(*book, "image_id"), [*book, "image_id"], "left_semi")


def context(caption: Column, before: Column, after: Column) -> Column:
    """Caption, text before and text after, by line, without empty ones, cut to 600 characters."""
    own = F.when(caption != "", F.concat(F.lit("Current caption: "), caption))
    parts = F.filter(F.array(own, before, after), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.left(F.array_join(parts, "\n"), F.lit(CONTEXT))


def contexts(blocks: DataFrame, chapter: list[str]) -> DataFrame:
    """Image blocks (chapter, block_index, image_id, caption) with the context that a provider is told."""
    near = nearest_text(blocks, chapter).where("type = 'image'")
    return near.select(*chapter, "block_index", "image_id", "caption", context(F.coalesce("caption", F.lit("")), F.col("before"), F.col("after")).alias("context"))


def image_fingerprint(model: str, threshold: float = THRESHOLD, captions: bool = True) -> Column:
    return fingerprint(F.lit(model), F.lit(repr(threshold)), F.lit(repr(captions)), F.col("context"), F.col("mime"), F.sha2("content", 256))


def number(value: object) -> float:
    """The value as a number; 0 for what is none."""
    try:
        return float(value)
    except (TypeError, ValueError):
        return 0.0


def read_verdict(raw: str) -> tuple[float, str | None, bool]:
    """(score, caption, whether the reply could be read); one that can't keeps its image."""
    span = re.search(r"(?s)\{.*\}", raw or "")
    try:
        said = json.loads(span[0], strict=False) if span else None
    except ValueError:
        said = None
    if not isinstance(said, dict):
        return 1.0, None, False
    caption = said.get("caption")
    return number(said.get("score")), caption if isinstance(caption, str) and caption.strip() else None, True


VERDICT = "keep boolean, score double, new_caption string"


def verdicts(images: DataFrame, keys: list[str], provider: Seeing, threshold: float = THRESHOLD) -> DataFrame:
    """keys, keep, score, new_caption, parsed, calls for images (keys, context, content, mime). Only parsed ones may be stored."""
    names = [*keys, "keep", "score", "new_caption", "parsed", "calls"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted = Counted(provider)
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                score, caption, parsed = read_verdict(counted.generate_with_image(PROMPT + (row[-3] or "(none)"), row[-2], row[-1]))
                out.append((*row[: len(keys)], score >= threshold, score, caption, parsed, counted.taken()))
            yield pd.DataFrame(out, columns=names)

    types = dict(images.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {VERDICT}, parsed boolean, calls {CALLS}"
    return images.select(*keys, "context", "content", "mime").mapInPandas(run, schema)


def resumed_verdicts(images: DataFrame, keys: list[str], provider: Seeing, log: DataFrame | None, *, model: str = "", threshold: float = THRESHOLD, captions: bool = True) -> DataFrame:
    """Verdicts with fingerprint and `reused`: of an earlier run where place, image, context and settings are the same and
    the stored one reads as a verdict, of the provider otherwise."""
    wanted = images.withColumn("fingerprint", image_fingerprint(model, threshold, captions))
    misses, on = wanted, [*keys, "fingerprint"]
    if log is not None:
        stored = log.select(*on, F.from_json("result", VERDICT).alias("r")).where("r.keep is not null and r.score is not null")
        hits = wanted.select(*on).join(stored, on)
        misses = wanted.join(hits.select(*keys), keys, "left_anti")
    fresh = verdicts(misses, keys, provider, threshold).join(misses.select(*on), keys).withColumn("reused", F.lit(False))
    if log is None:
        return fresh
    old = hits.select(*on, "r.*").withColumns({"parsed": F.lit(True), "calls": F.array().cast(CALLS), "reused": F.lit(True)})
    return fresh.unionByName(old)


def storable_verdicts(judged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fingerprint, result) of fresh verdicts that could be read."""
    said = F.to_json(F.struct("keep", "score", "new_caption"))
    return judged.where("parsed and not reused").select(*keys, "fingerprint", said.alias("result"))


def ranked(blocks: DataFrame, judged: DataFrame, chapter: list[str], captions: bool = True) -> DataFrame:
    """Blocks without the images that were judged not to stay, the others under the captions that were given them."""
    on = [*chapter, "block_index"]
    held = blocks.join(judged.select(*on, "keep", "new_caption"), on, "left").where("coalesce(keep, true)")
    caption = F.coalesce("new_caption", "caption") if captions else F.col("caption")
    return held.withColumn("caption", caption).select(blocks.columns)
