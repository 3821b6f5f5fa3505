"""Condensing and smoothing through a text provider, as passes over rows that hold one chunk or chapter each.

A row has its blocks, numbered and grouped into runs, and the prompt that was built for them with column expressions.
The pass asks the provider, reads its reply and puts the blocks together again; what decides whether a row is asked at
all, asked again or stored are filters between passes. Without prose a row never reaches the provider. A reply that
can't be read, or in which not one run can, is asked for again; after the last try the row keeps its blocks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foliant.functions import prompts as P
from foliant.functions.cost import CALIBRATIONS, target_tokens
from foliant.functions.provider import CALLS, USAGE, Counted, Provider
from foliant.functions.text import block_text, count_tokens, fingerprint
from foliant.operators.blocks import chunk_table, runs
from foliant.operators.condense import TRIM_OVER
from foliant.operators.replies import read_reply
from foliant.workspace import Workspace

TRIES, TRIMS, RATIO = 3, 1, 0.30
#: What a block carries from the source to the renderers.
BLOCK = (
    "type string, level int, text string, items array<string>, ordered boolean, rows array<array<string>>, language string, image_id string, caption string, "
    "rich string, items_rich array<string>, align string, anchor_id string, marker_type string, marker_color string"
)
FIELDS = [f.split()[0] for f in BLOCK.split(", ")]
BLOCKS = f"array<struct<{BLOCK}>>"
ANSWER = f"answered boolean, degraded int, kept array<string>, dropped array<string>, blocks {BLOCKS}, calls {CALLS}"
#: What a phase leaves of each chunk or chapter.
CONDENSED = (
    f"input_tokens long, degraded int, kept array<string>, dropped array<string>, blocks {BLOCKS}, calls {CALLS}, "
    "output_tokens long, over_length boolean, failed boolean"
)
SYNTHESIZED = (
    f"blocks {BLOCKS}, kept array<string>, input_tokens long, chunks long, chunk_degraded int, target_tokens long, output_tokens long, "
    f"smoothed boolean, trim_passes int, degraded int, calls {CALLS}, failed boolean"
)
SHELL = ("ordered", "align", "marker_type", "marker_color")


def read_answer(raw: str) -> tuple[dict[str, object], set[str]] | None:
    """(text of each run, images to keep) of a reply; null unless it holds a JSON object."""
    span = re.search(r"(?s)\{.*\}", raw or "")
    try:
        said = json.loads(span[0], strict=False) if span else None
    except ValueError:
        said = None
    if not isinstance(said, dict):
        return None
    texts, images = said.get("texts"), said.get("essential_images")
    usable = {k: v for k, v in texts.items() if isinstance(v, (str, list))} if isinstance(texts, dict) else {}
    return usable, {str(i) for i in images} if isinstance(images, list) else set()


def rebuild(blocks: list[dict], texts: dict[str, object], images: set[str] | None) -> dict:
    """The blocks with each run's replaced by what was said for it; images not named go, unless images is null."""
    members: dict[int, list[dict]] = {}
    for block in blocks:
        members.setdefault(block["run_id"], []).append(block)
    out: list[dict] = []
    kept, dropped, degraded, done = [], [], 0, set()
    for block in blocks:
        run = block["run_id"]
        own = {f: block[f] for f in FIELDS}
        if block["type"] == "image":
            keep = images is None or block["image_id"] in images
            (kept if keep else dropped).append(block["image_id"])
            out += [own] if keep else []
        elif run is None:
            out.append(own)
        elif run not in done:
            done.add(run)
            source = members[run]
            pieces = read_reply([b["type"] for b in source], texts.get(str(run)))
            degraded += pieces is None
            out += [{f: b[f] for f in FIELDS} for b in source] if pieces is None else [_piece(p, source) for p in pieces]
    return {"degraded": degraded, "kept": kept, "dropped": dropped, "blocks": out}


def _piece(piece: dict, source: list[dict]) -> dict:
    made = dict.fromkeys(FIELDS) | {k: piece[k] for k in ("type", "text", "items")}
    if piece["source"]:
        shell = source[piece["source"] - 1]
        made |= {f: shell[f] for f in SHELL} | {"anchor_id": shell["anchor_id"] if piece["anchored"] else None}
    return made


def ask(provider: Provider, system: str, user: str, blocks: list[dict], choose: bool, tries: int = TRIES) -> dict:
    """One row's answer; choose: whether the reply says which images stay."""
    n = len({b["run_id"] for b in blocks} - {None})
    for _ in range(tries if n else 0):
        read = read_answer(provider.generate(system, user))
        if read is None:
            continue
        made = rebuild(blocks, read[0], read[1] if choose else None)
        if made["degraded"] < n:
            return made | {"answered": True}
    return rebuild([b | {"run_id": None} for b in blocks], {}, None) | {"answered": not n}


def asked(rows: DataFrame, keys: list[str], provider: Provider, system: str, choose: bool, tries: int = TRIES) -> DataFrame:
    """keys and ANSWER for rows (keys, user, blocks with run_id)."""
    names = ["answered", "degraded", "kept", "dropped", "blocks", "calls"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted = Counted(provider)
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                blocks = [_plain(b) for b in row[-1]]
                made = ask(counted, system, row[-2], blocks, choose, tries) | {"calls": counted.taken()}
                out.append((*row[: len(keys)], *(made[n] for n in names)))
            yield pd.DataFrame(out, columns=[*keys, *names])

    types = dict(rows.dtypes)
    return rows.select(*keys, "user", "blocks").mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + ANSWER)


def _plain(block: dict) -> dict:
    """A block as Arrow hands it over, with lists for arrays and null for what isn't there."""
    out = {}
    for name, value in dict(block).items():
        if hasattr(value, "tolist"):
            value = [list(x) if hasattr(x, "tolist") else x for x in value]
        out[name] = None if isinstance(value, float) and value != value else value
    for name in ("level", "run_id"):
        out[name] = None if out.get(name) is None else int(out[name])
    return out


def whole(blocks: DataFrame) -> DataFrame:
    """blocks with a null column for each field of BLOCK that they lack, and their tokens."""
    lacking = {f.split()[0]: F.lit(None).cast(f.split(" ", 1)[1]) for f in BLOCK.split(", ") if f.split()[0] not in blocks.columns}
    full = blocks.withColumns(lacking)
    tokens = count_tokens(block_text(*(F.col(c) for c in ("type", "text", "items", "rows", "caption"))))
    return full.withColumn("tokens", F.coalesce(tokens, F.lit(0)).cast("long"))


def numbered(blocks: DataFrame, keys: list[str], image_ids: bool) -> DataFrame:
    """keys, blocks (with run_id, in order), body of the prompt, image ids and tokens: one row for each of keys."""
    lines = P.lines(runs(blocks, keys), keys, image_ids)
    one = F.struct("block_index", "_line", "tokens", F.struct(*FIELDS, "run_id").alias("b"))
    held = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(one), lambda x, y: (x["block_index"] - y["block_index"]).cast("int")).alias("h"))
    held = held.withColumn("blocks", F.col("h.b"))
    return held.select(
        *keys, "blocks", P.strip(F.array_join("h._line", "\n")).alias("body"),
        F.transform(F.filter("blocks", lambda b: b["type"] == "image"), lambda b: b["image_id"]).alias("image_ids"),
        F.aggregate("h.tokens", F.lit(0).cast("long"), lambda a, t: a + t).alias("tokens"), F.exists("blocks", lambda b: b["run_id"].isNotNull()).alias("has_prose"),
    )


def tokens_of(blocks: Column) -> Column:
    one = lambda b: count_tokens(block_text(b["type"], b["text"], b["items"], b["rows"], b["caption"]))
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.coalesce(one(b), F.lit(0)))


def bare(blocks: Column) -> Column:
    return F.transform(blocks, lambda b: F.struct(*(b[f].alias(f) for f in FIELDS)))


def no_calls() -> Column:
    return F.array().cast(CALLS)


def ask_factor(model: str) -> float:
    return CALIBRATIONS.get(model, (1.0, 0.0))[0]


def chunk_rows(blocks: DataFrame, chapter: list[str], most: int = 2000) -> DataFrame:
    """Chunks of chapters (keys chapter and chunk_no) as rows of `numbered`, with input_tokens."""
    full = whole(blocks)
    chunks = full.join(chunk_table(full, chapter, most), [*chapter, "block_index"])
    return numbered(chunks, [*chapter, "chunk_no"], True).withColumnRenamed("tokens", "input_tokens")


def chunk_fingerprint(model: str, ratio: float) -> Column:
    """Over the model, the ratio asked for and the blocks in order."""
    said = F.to_json(F.struct(bare(F.col("blocks")).alias("b")))
    return fingerprint(F.lit("chunk 1"), F.lit(model), F.lit(repr(ratio)), F.lit(repr(round(ask_factor(model), 4))), said)


def condense(chunks: DataFrame, keys: list[str], provider: Provider, *, model: str = "", ratio: float = RATIO, tries: int = TRIES) -> DataFrame:
    """Answers for rows of `chunk_rows` with input_tokens, output_tokens, over_length and failed.

    The ratio asked for is the target corrected by what is known of the model. Chunks without prose pass as they are.
    """
    user = P.condense_prompt(F.col("body"), F.lit(ratio * ask_factor(model)), F.col("image_ids"))
    out = asked(chunks.withColumn("user", user), [*keys, "input_tokens"], provider, P.CONDENSE_SYSTEM, True, tries).withColumn("output_tokens", tokens_of(F.col("blocks")))
    return out.withColumn("over_length", F.col("output_tokens") > F.col("input_tokens")).withColumn("failed", ~F.col("answered")).drop("answered")


def chapters_of(condensed: DataFrame, chapter: list[str]) -> DataFrame:
    """One row per chapter: the blocks of its chunks in order, numbered anew, and sums over its chunks."""
    sums = F.sum("input_tokens").alias("input_tokens"), F.count("*").alias("chunks"), F.sum("degraded").cast("int").alias("chunk_degraded")
    held = condensed.groupBy(*chapter).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "blocks", "kept"))).alias("c"), *sums)
    return held.select(*chapter, F.flatten("c.blocks").alias("blocks"), F.flatten("c.kept").alias("kept"), "input_tokens", "chunks", "chunk_degraded")


def _renumbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, blocks) as rows of `numbered` for a smoothing prompt."""
    flat = rows.select(*keys, F.posexplode("blocks").alias("block_index", "b")).select(*keys, "block_index", "b.*")
    return numbered(whole(flat), keys, False)


def synthesize(chapters: DataFrame, chapter: list[str], provider: Provider, *, ratio: float = RATIO, tries: int = TRIES, trims: int = TRIMS) -> DataFrame:
    """Rows of `chapters_of` with blocks, kept, input_tokens, target_tokens, output_tokens, smoothed, trim_passes, degraded and failed.

    A chapter without prose, or of one chunk within its target, isn't asked about. After the smooth pass come at most
    `trims` passes over chapters that still exceed the target by more than 15 %; one that can't be read ends there, and
    so does one that came back no shorter, which counts but is thrown away.
    """
    base = chapters.withColumn("target_tokens", target_tokens(F.col("input_tokens"), ratio)).withColumn("now", tokens_of(F.col("blocks")))
    prose = F.exists("blocks", lambda b: b["type"].isin("paragraph", "quote", "list"))
    base = base.withColumn("smoothed", prose & ~((F.col("chunks") == 1) & (F.col("now") <= F.col("target_tokens"))))
    state = base.withColumns({"trim_passes": F.lit(0), "degraded": F.lit(0), "calls": no_calls(), "failed": F.lit(False), "open": F.col("smoothed")})
    names, work = state.columns, Workspace(chapters.sparkSession, "synthesize")
    state = work.put(state, "chapters")  # each pass is written, so that no provider is asked twice
    for smooth in (True, *(False,) * trims):
        due = state.where("open")
        rows = _renumbered(due.select(*chapter, "blocks"), chapter).join(due.select(*chapter, "target_tokens"), chapter)
        rows = rows.withColumn("user", P.synthesis_prompt(F.col("body"), F.col("target_tokens"), smooth))
        said = asked(rows, chapter, provider, P.CONDENSE_SYSTEM, False, tries)
        said = said.select(
            *chapter, "answered", F.col("degraded").alias("new_degraded"), F.col("blocks").alias("new_blocks"), F.col("calls").alias("new_calls"),
            tokens_of(F.col("blocks")).alias("new_now"),
        )
        done = state.join(said, chapter, "left")
        answered = F.coalesce("answered", F.lit(False))
        take = answered & (F.lit(smooth) | (F.col("new_now") < F.col("now")))
        pick = lambda new, old: F.when(take, F.col(new)).otherwise(F.col(old))  # noqa: B023, E731
        state = work.put(done.select(
            *chapter, pick("new_blocks", "blocks").alias("blocks"), "kept", "input_tokens", "chunks", "chunk_degraded", "target_tokens", pick("new_now", "now").alias("now"), "smoothed",
            (F.col("trim_passes") + (answered & F.lit(not smooth)).cast("int")).alias("trim_passes"),
            (F.col("degraded") + F.when(take, F.col("new_degraded")).otherwise(0)).alias("degraded"),
            F.concat("calls", F.coalesce("new_calls", no_calls())).alias("calls"),
            (F.col("failed") | (F.lit(smooth) & F.col("open") & ~answered)).alias("failed"),
            (take & (pick("new_now", "now") > F.col("target_tokens") * TRIM_OVER)).alias("open"),
        ).select(names), "pass")
    return state.drop("open").withColumnRenamed("now", "output_tokens")


def degraded_total(condensed: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row: how many passages kept their wording over all chunks and chapters, and one warning if any did."""
    n = condensed.select("degraded").unionByName(chapters.select("degraded")).agg(F.coalesce(F.sum("degraded"), F.lit(0)).alias("degraded"))
    return n.withColumn("warning", F.when(F.col("degraded") > 0, F.concat(F.col("degraded").cast("string"), F.lit(" passages kept their wording: the reply for them didn't have the expected form"))))


def chapter_fingerprint(model: str, ratio: float) -> Column:
    """Over the model, what governs the length, and the chapter's condensed blocks with the size of their sources."""
    said = F.to_json(F.struct("input_tokens", "kept", bare(F.col("blocks")).alias("b")))
    return fingerprint(F.lit("chapter 1"), F.lit(model), F.lit(repr(ratio)), F.lit(repr((TRIM_OVER, TRIMS))), said)


def resumed(wanted: DataFrame, log: DataFrame | None, keys: list[str], schema: str, compute) -> tuple[DataFrame, DataFrame]:
    """(results with `reused`, what may be appended to the log) for wanted rows (keys, fingerprint and compute's input).

    schema: the results' columns besides keys.
    A stored result (keys, fingerprint, result as JSON) is used where key and fingerprint agree and it reads as one with
    blocks; all other rows are computed. What failed isn't stored, so that the next run tries it again.
    """
    fields = T.StructType.fromDDL(schema)
    names = fields.names
    misses = wanted
    if log is not None:
        stored = log.withColumn("r", F.from_json("result", fields)).where("r.blocks is not null")
        took = lambda n: no_calls() if n == "calls" else F.col("r")[n]  # noqa: E731  what is reused takes no call
        hits = wanted.select(*keys, "fingerprint").join(stored.select(*keys, "fingerprint", "r"), [*keys, "fingerprint"]).select(*keys, "fingerprint", *(took(n).alias(n) for n in names))
        misses = wanted.join(hits.select(*keys), keys, "left_anti")
    fresh = compute(misses).join(misses.select(*keys, "fingerprint"), keys).select(*keys, "fingerprint", *names)
    results = fresh.withColumn("reused", F.lit(False))
    if log is not None:
        results = results.unionByName(hits.withColumn("reused", F.lit(True)))
    return results, results.where("not failed and not reused").select(*keys, "fingerprint", F.to_json(F.struct(*names)).alias("result"))


def reuse_counters(results: dict[str, DataFrame]) -> DataFrame:
    """(phase, total, reused) for each phase's results."""
    rows = [df.agg(F.count("*").alias("total"), F.count_if(F.col("reused")).alias("reused")).select(F.lit(name).alias("phase"), "*") for name, df in results.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def flattened(chapters: DataFrame, chapter: list[str]) -> DataFrame:
    """One row per block of chapters, numbered anew."""
    return chapters.select(*chapter, F.posexplode("blocks").alias("block_index", "b")).select(*chapter, "block_index", "b.*")


def kept_assets(assets: DataFrame, chapters: DataFrame, book: list[str]) -> DataFrame:
    """Assets (book, image_id) that some chapter of the book kept."""
    return assets.join(chapters.select(*book, F.explode("kept").alias("image_id")), [*book, "image_id"], "left_semi")


def first_titles(chapters: DataFrame, chapter: list[str]) -> DataFrame:
    """(chapter, title): the first heading's text."""
    heading = F.when(F.col("type") == "heading", F.struct("block_index", "text"))
    return chapters.groupBy(*chapter).agg(F.min(heading)["text"].alias("title"))


def usage(results: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(phase, keys, calls, and the sum of each of USAGE) of the calls that phases made, from their results' `calls`.

    Results without a call give a row of zeros, so that every phase and book is in the table.
    """
    out = None
    for name, df in results.items():
        each = df.select(*keys, F.explode_outer("calls").alias("c"))
        sums = [F.coalesce(F.sum(F.col("c")[n]), F.lit(0)).cast("long").alias(n) for n in USAGE]
        rows = each.groupBy(*keys).agg(F.count("c").alias("calls"), *sums).select(F.lit(name).alias("phase"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out
