"""Translation of chapters by numbered units in batches, halved where a reply can't be read."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions import prompts as P
from foliant.functions.provider import CALLS, Counted, Provider
from foliant.operators.blocks import unit_batches
from foliant.sources import html as H
from foliant.workspace import Workspace

BATCH, TRIES = 40, 2


def units_of(titles: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Units of chapters: the title, then headings, paragraphs, quotes and each list item, in order (place)."""
    head = titles.where("title is not null and title != ''").select(*keys, F.struct(F.lit(-1).alias("block"), F.lit(0).alias("item")).alias("place"), F.col("title").alias("text"))
    parts = F.when(F.col("type") == "list", F.col("items")).when(F.col("type").isin("heading", "paragraph", "quote"), F.array("text"))
    rest = blocks.select(*keys, "block_index", F.posexplode(parts).alias("item", "text"))
    return head.unionByName(rest.select(*keys, F.struct(F.col("block_index").alias("block"), "item").alias("place"), "text"))


def ask(batch: dict[str, str], provider: Callable[[dict[str, str]], str], tries: int = TRIES) -> dict[str, str]:
    """Translations by unit. A batch whose replies can't be read is halved, down to single units, which then stay out."""
    done: dict[str, str] = {}
    waiting = [list(batch)]
    while waiting:
        ids = waiting.pop()
        for _ in range(tries):
            said = provider({i: batch[i] for i in ids})
            try:
                reply = json.loads(said[said.index("{") : said.rindex("}") + 1], strict=False)
            except ValueError:
                continue
            held = reply.get("translations")
            if isinstance(held, dict):
                done |= {i: t for i, t in held.items() if i in ids and isinstance(t, str)}
            break
        else:
            if len(ids) > 1:
                waiting += [ids[len(ids) // 2 :], ids[: len(ids) // 2]]
    return done


def translate_units(units: DataFrame, keys: list[str], order: str, provider: Callable[[dict[str, str]], str], size: int = BATCH) -> DataFrame:
    """units (text) with unit, batch_start, translated and text replaced where the provider answered for it."""
    return ask_batches(batches_of(unit_batches(units, keys, order, size), keys), keys, provider).drop("calls")


def batches_of(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, batch_start, b: its units in order) of units numbered by `unit_batches`."""
    return numbered.groupBy(*keys, "batch_start").agg(F.array_sort(F.collect_list(F.struct("unit", "text"))).alias("b"))


def ask_batches(batches: DataFrame, keys: list[str], provider: Callable[[dict[str, str]], str]) -> DataFrame:
    """keys, batch_start, unit, text, translated of each unit of `batches_of`; calls are with a batch's first unit."""
    by = [*keys, "batch_start"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted, call = None, provider
        if isinstance(provider, Translator):
            counted = Counted(provider.provider)
            call = Translator(counted, provider.target, provider.terms, provider.source)
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                texts = {str(b["unit"]): b["text"] or "" for b in row[-1]}
                said = ask(texts, call)
                taken = counted.taken() if counted else []
                for i, t in texts.items():
                    out.append((*row[:-1], int(i), said.get(i, t), i in said, taken))
                    taken = []
            yield pd.DataFrame(out, columns=[*by, "unit", "text", "translated", "calls"])

    types = dict(batches.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in by) + f", unit int, text string, translated boolean, calls {CALLS}"
    return batches.select(*by, "b").mapInPandas(run, schema)


def stored_answers(batches: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, batch_start, said: text by unit) of wanted batches (fingerprint, b) that an earlier run stored.

    A stored answer is used if its fingerprint is the batch's, it reads as texts by name, and its names are exactly the
    batch's units: neither one too few nor one too many.
    """
    by = [*keys, "batch_start"]
    said = F.try_variant_get(F.try_parse_json("result"), "$", "map<string,variant>")
    held = log.select(*by, "fingerprint", said.alias("v")).where("v is not null")
    texts = F.forall(F.map_values("v"), lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    held = held.where(texts).select(*by, "fingerprint", F.transform_values("v", lambda _, x: x.cast("string")).alias("said"))
    both = batches.select(*by, "fingerprint", F.transform("b", lambda u: u["unit"].cast("string")).alias("wanted")).join(held, [*by, "fingerprint"])
    names = F.map_keys("said")
    same = (F.size(F.array_except(names, "wanted")) == 0) & (F.size(F.array_except("wanted", names)) == 0)
    return both.where(same).select(*by, "said")


def resumed_batches(units: DataFrame, keys: list[str], order: str, provider: Callable[[dict[str, str]], str], log: DataFrame | None, target: str, *fields: str, size: int = BATCH) -> DataFrame:
    """Answers of `ask_batches` with fingerprint and `reused`: stored ones where they hold, the others asked for."""
    by = [*keys, "batch_start"]
    numbered = unit_batches(units, keys, order, size)
    batches = batches_of(numbered, keys).join(batch_fingerprints(numbered, keys, target, *fields), by)
    misses = batches
    if log is not None:
        hits = stored_answers(batches, log, keys)
        misses = batches.join(hits.select(*by), by, "left_anti")
    fresh = ask_batches(misses, keys, provider).join(misses.select(*by, "fingerprint"), by).withColumn("reused", F.lit(False))
    if log is None:
        return fresh
    old = hits.join(batches.select(*by, "fingerprint"), by).select(*by, "fingerprint", F.explode("said").alias("unit", "text"))
    old = old.withColumns({"unit": F.col("unit").cast("int"), "translated": F.lit(True), "calls": F.array().cast(CALLS), "reused": F.lit(True)})
    return fresh.unionByName(old)


def storable(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, batch_start, fingerprint, result) of fresh batches that were answered whole; others are asked again next time."""
    by = [*keys, "batch_start"]
    pairs = F.array_sort(F.collect_list(F.struct(F.col("unit").cast("string").alias("k"), F.col("text").alias("v"))))
    held = answers.where("not reused").groupBy(*by, "fingerprint").agg(F.bool_and("translated").alias("whole"), pairs.alias("p")).where("whole")
    return held.select(*by, "fingerprint", F.to_json(F.map_from_entries("p")).alias("result"))


def batch_counters(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(phase, total, reused) over batches."""
    each = answers.groupBy(*keys, "batch_start").agg(F.first("reused").alias("reused"))
    return each.agg(F.count("*").alias("total"), F.count_if("reused").alias("reused")).select(F.lit("translate").alias("phase"), "*")


def batch_fingerprints(units: DataFrame, keys: list[str], target: str, *fields: str) -> DataFrame:
    """keys, batch_start, fingerprint: over the language, further fields, and the units sorted by their numbers as text."""
    one = F.struct(F.col("unit").cast("string").alias("id"), "text")
    held = units.groupBy(*keys, "batch_start").agg(F.array_sort(F.collect_list(one)).alias("u"))
    body = F.array_join(F.transform("u", lambda x: F.concat(x["id"], F.lit("\0"), x["text"], F.lit("\0"))), "")
    head = "".join(f"{f}\0" for f in ("batch 1", target, *fields))
    return held.select(*keys, "batch_start", F.sha1(F.concat(F.lit(head), body)).alias("fingerprint"))


def complete_batches(translated: DataFrame, keys: list[str]) -> DataFrame:
    """Batches that may be stored: every unit was answered."""
    return translated.groupBy(*keys, "batch_start").agg(F.bool_and("translated").alias("whole"), F.count("*").alias("units")).where("whole").drop("whole")


def faithful(source: Column, reply: Column) -> Column:
    """Struct (text, rich, downgraded): the reply's markup stays if it has the source's tags, else its plain text."""
    same = H.tag_signature(reply) == H.tag_signature(source)
    return F.struct(H.strip_tags(reply).alias("text"), F.when(same, reply).alias("rich"), (~same).alias("downgraded"))


class Translator:
    """The call for a batch of units, through a text provider."""

    def __init__(self, provider: Provider, target: str, terms: dict[str, str] | None = None, source: str | None = None):
        self.provider, self.target, self.terms, self.source = provider, target, terms, source

    def __call__(self, batch: dict[str, str]) -> str:
        return self.provider.generate(P.TRANSLATE_SYSTEM, P.translate_user(batch, self.target, self.terms, self.source))


def marked_units(blocks: DataFrame, titles: DataFrame, chapter: list[str]) -> DataFrame:
    """Units of chapters as they go out, with their markup."""
    marked = blocks.withColumn("text", F.coalesce("rich", "text")).withColumn("items", F.coalesce("items_rich", "items"))
    return units_of(titles, marked, chapter)


def translate_blocks(blocks: DataFrame, titles: DataFrame, chapter: list[str], call: Callable[[dict[str, str]], str], size: int = BATCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, titles, per chapter: units, untranslated, downgraded) with texts replaced by their translations."""
    units = marked_units(blocks, titles, chapter)
    answers = Workspace(blocks.sparkSession, "translate").put(translate_units(units, chapter, "place", call, size))  # asked once
    return answered_blocks(blocks, titles, chapter, answers, size)


def answered_blocks(blocks: DataFrame, titles: DataFrame, chapter: list[str], answers: DataFrame, size: int = BATCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same from answers (chapter, unit, text, translated). A reply is cleaned, and keeps its markup if that has the source's tags."""
    units = marked_units(blocks, titles, chapter)
    numbered = unit_batches(units, chapter, "place", size).select(*chapter, "unit", "place", F.col("text").alias("own"))
    said = answers.select(*chapter, "unit", "text", "translated").join(numbered, [*chapter, "unit"])
    reply = H.sanitize(F.when(F.col("translated"), F.col("text")))
    said = said.withColumn("f", F.when(F.col("translated"), faithful(F.col("own"), reply)))
    said = said.select(*chapter, "place", "translated", F.when(F.col("translated"), F.col("f.text")).alias("text"), F.when(H.has_markup(F.col("f.rich")), F.col("f.rich")).alias("rich"), F.coalesce("f.downgraded", F.lit(False)).alias("downgraded"))
    counts = said.groupBy(*chapter).agg(F.count("*").alias("units"), F.count_if(~F.col("translated")).alias("untranslated"), F.count_if(F.col("downgraded")).alias("downgraded"))
    new_titles = said.where("place.block = -1 and translated").select(*chapter, F.col("text").alias("_title"))
    titled = titles.join(new_titles, chapter, "left").withColumn("title", F.coalesce("_title", "title")).drop("_title")
    per = said.where("place.block >= 0").groupBy(*chapter, F.col("place.block").alias("block_index")).agg(F.array_sort(F.collect_list(F.struct("place", "translated", "text", "rich"))).alias("_u"))
    held = blocks.join(per, [*chapter, "block_index"], "left")
    first = F.get("_u", F.lit(0))
    done = F.coalesce(first["translated"], F.lit(False)) & (F.col("type") != "list")
    item = lambda u, i: F.when(u["translated"], u["text"]).otherwise(F.get("items", i))
    item_rich = lambda u, i: F.when(u["translated"], F.coalesce(u["rich"], H.text_as_markup(u["text"]))).otherwise(F.coalesce(F.get("items_rich", i), H.text_as_markup(F.get("items", i))))
    list_ = (F.col("type") == "list") & F.col("_u").isNotNull()
    any_rich = F.exists("_u", lambda u: u["rich"].isNotNull()) | (F.col("items_rich").isNotNull() & F.exists("_u", lambda u: ~u["translated"]))
    out = held.withColumns({
        "text": F.when(done, first["text"]).otherwise(F.col("text")), "rich": F.when(done, first["rich"]).otherwise(F.col("rich")),
        "items": F.when(list_, F.transform("_u", item)).otherwise(F.col("items")),
        "items_rich": F.when(list_, F.when(any_rich, F.transform("_u", item_rich))).otherwise(F.col("items_rich")),
    })
    return out.select(blocks.columns), titled, counts
