"""Prompts and small inputs of the provider stages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from foliant.functions.text import strip

CONDENSE_SYSTEM = "You edit technical books. You shorten prose without changing its facts, and leave code alone."
TRANSLATE_SYSTEM = "You translate technical prose faithfully; code, names, addresses and numbers stay as they are."


# The wording of the markers below must match what providers were tuned on.
def caption_note(caption: Column) -> Column:
    return F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit(' — "'), caption, F.lit('"'))).otherwise("")


def marker(kind: Column, level: Column, text: Column, language: Column, caption: Column) -> Column:
    """What stands in a prompt for a block that isn't to be rewritten."""
    fence = F.concat(F.lit("[CODE BLOCK - preserved verbatim, do not reproduce]\n```"), F.coalesce(language, F.lit("")), F.lit("\n"), F.regexp_replace(text, r"(?U)\s+$", ""), F.lit("\n```"))
    return (
        F.when(kind == "heading", F.concat(F.lit("[HEADING] "), F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(kind == "code", fence)
        .when(kind == "table", "[TABLE - preserved]")
        .when(kind == "image", F.concat(F.lit("[IMAGE"), caption_note(caption), F.lit("]")))
        .otherwise("")
    )


def lines(runs: DataFrame, keys: list[str], image_ids: bool = True) -> DataFrame:
    """runs with _line, what stands in a prompt for each block; images by id, or by a marker where the ids aren't asked for."""
    place = W.partitionBy(*keys).orderBy("block_index")
    k = F.row_number().over(W.partitionBy(*keys, "run_id").orderBy("block_index")).cast("string")
    first = F.lag("run_id").over(place).isNull() | (F.lag("run_id").over(place) != F.col("run_id"))
    said = F.when(F.col("type") == "list", F.array_join(F.transform("items", lambda i: F.concat(F.lit("- "), i)), "\n")).otherwise(F.col("text")) if "items" in runs.columns else F.col("text")
    block = F.concat(F.lit("[BLOCK "), k, F.lit(" type="), "type", F.lit("]\n"), said)
    text = F.concat(F.when(first, F.concat(F.lit("\n[TEXT "), F.col("run_id").cast("string"), F.lit("]\n"))).otherwise(""), block)
    image = F.concat(F.lit("\n[IMG:"), "image_id", caption_note(F.col("caption")), F.lit("]"))
    other = F.concat(F.lit("\n"), marker(F.col("type"), F.col("level"), F.col("text"), F.col("language"), F.col("caption")))
    by_id = (F.col("kind") == "image") & F.lit(image_ids)
    return runs.withColumn("_line", F.when(F.col("kind") == "text", text).when(by_id, image).otherwise(other))


def bodies(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and body: the blocks of a chunk in order, runs under [TEXT n] with their blocks numbered, parted by blank lines.

    runs hold type, kind, run_id, block_index, text, level, language, image_id and caption.
    """
    held = lines(runs, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block_index", "_line")))["_line"].alias("_l"))
    return held.select(*keys, strip(F.array_join("_l", "\n")).alias("body"))


def percent(ratio: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(ratio.cast("double") * 100).cast("int"))


def words(tokens: Column) -> Column:
    return F.greatest(F.lit(1), F.rint(tokens.cast("double") / 1.3).cast("int"))


def condense_prompt(body: Column, ratio: Column, image_ids: Column) -> Column:
    known = F.when(F.size(image_ids) > 0, F.array_join(image_ids, ", ")).otherwise("(none)")
    return F.concat(
        F.lit("Shorten the excerpt to about "), percent(ratio).cast("string"), F.lit("% of its length. Rewrite each [TEXT n] alone; answer for each with an array of "
        '{"block": k, "type": ..., "text" or "items": ...} in ascending order, naming every list and quote once. '
        'Return only {"texts": {"1": [...]}, "essential_images": [ids]}.\nImages: '), known, F.lit("\n\n"), body,
    )


def synthesis_prompt(body: Column, tokens: Column, smooth: bool = True) -> Column:
    task = "Smooth and shorten" if smooth else "Shorten further"
    return F.concat(F.lit(f"{task} this chapter to about "), words(tokens).cast("string"), F.lit(' words. Return only {"texts": {"1": [...]}}.\n\n'), body)


def translate_user(batch: dict[str, str], target: str, terms: dict[str, str] | None = None, source: str | None = None) -> str:
    """The prompt for a batch of units (number, text) in order; terms: source to target, may be empty."""
    lines = [f"Translate the numbered segments {f'from {source} ' if source else ''}to {target}, markup unchanged. " 'Return only {"translations": {"1": "..."}}.']
    lines += [f"- {a} → {b}" for a, b in (terms or {}).items()]
    return "\n".join([*lines, "", *(f"[{i}] {t}" for i, t in batch.items())])


def glossary(json_text: Column) -> Column:
    """Map of source to target terms; blank terms fall away, null for what isn't an object."""
    read = F.from_json(json_text, "map<string,string>")
    return F.map_filter(read, lambda a, b: (strip(a) != "") & (strip(F.coalesce(b, F.lit(""))) != ""))


def glossary_lines(terms: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(terms), lambda e: F.concat(F.lit("- "), e["key"], F.lit(" → "), e["value"])), "\n")


def manual_toc(spark: SparkSession, path: str) -> DataFrame:
    """(title, start_page, ord) of a JSON list; a wrong shape fails."""
    read = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<title: string, start_page: int>>", {"mode": "FAILFAST"})).alias("ord", "e"))
    return read.select("e.title", F.assert_true(F.col("e.title").isNotNull() & F.col("e.start_page").isNotNull(), "an entry needs title and start_page").alias("_ok"), "e.start_page", "ord").where("_ok is null").drop("_ok")


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, prompt_tokens, completion_tokens) with cost; null where the model has no price or a total of 0.

    prices (model, prompt_price, completion_price) are per token.
    """
    total = F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price")
    return usage.join(prices, "model", "left").withColumn("cost", F.when(total > 0, total)).drop("prompt_price", "completion_price")
