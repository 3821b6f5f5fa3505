"""What a provider's reply makes of a run of blocks.

A reply is read into pieces, each with the ordinal of the block that it stands for. The rules are then about the list
of ordinals: named ones must exist and ascend, and a list or quote must be named exactly once. A run whose reply breaks
a rule keeps its own blocks and counts as degraded; its neighbours are untouched.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

PIECE = "source int, anchored boolean, type string, text string, items array<string>"
RESULT = f"degraded boolean, pieces array<struct<{PIECE}>>"


def _ordinal(entry) -> int | None:
    named = entry.get("block") if isinstance(entry, dict) else None
    if isinstance(named, str) and named.strip().isdigit():
        return int(named)
    return named if type(named) is int else None  # a truth value is no number


def _content(kind: str, entry) -> tuple[str | None, list[str] | None] | None:
    """(text, items) of an entry for a block of that kind; null if it has none or is of another kind."""
    if kind == "paragraph" and isinstance(entry, str):
        entry = {"text": entry}
    if not isinstance(entry, dict) or entry.get("type", kind if kind == "paragraph" else None) not in ((kind, None) if kind == "paragraph" else (kind,)):
        return None
    if kind == "list":
        held = entry.get("items")
        items = [x for x in (str(i).strip() for i in held) if x] if isinstance(held, list) else []
        return (None, items) if items else None
    text = entry.get("text")
    text = text.strip() if isinstance(text, str) else ""
    return (text, None) if text else None


def read_reply(kinds: list[str], value) -> list[dict] | None:
    """Pieces for a run of blocks of these kinds (paragraph, quote, list); null if the reply can't stand for them."""
    n, plain = len(kinds), set(kinds) <= {"paragraph"}
    if isinstance(value, str):
        if not plain:
            return None
        value = [p for p in (p.strip() for p in re.split(r"\n\s*\n", value)) if p]
        sources = [1] if len(value) == n == 1 else [0] * len(value)
    elif isinstance(value, list):
        named = [_ordinal(e) for e in value]
        if named and None not in named:
            sources = named
            known = all(1 <= s <= n for s in sources) and sources == sorted(sources)
            if not known or any(sources.count(k) != 1 for k, kind in enumerate(kinds, 1) if kind != "paragraph"):
                return None
        elif len(value) == n:
            sources = list(range(1, n + 1))
        elif plain:
            sources = [0] * len(value)
        else:
            return None
    else:
        return None
    pieces = []
    for place, (source, entry) in enumerate(zip(sources, value)):
        kind = kinds[source - 1] if source else "paragraph"
        content = _content(kind, entry)
        if content is None:
            return None
        # The first piece of a split block keeps its anchor: an anchor names one place.
        first = source > 0 and source not in sources[:place]
        pieces.append({"source": source or None, "anchored": first, "type": kind, "text": content[0], "items": content[1]})
    return pieces


def rebuilt(blocks: Column, reply: Column) -> Column:
    """Struct (degraded, pieces) of a run: blocks is an array of (type, text, items), reply the JSON of its value."""

    @F.pandas_udf(RESULT)
    def run(held: pd.Series, replies: pd.Series) -> pd.DataFrame:
        out = []
        for own, said in zip(held, replies):
            own = [] if own is None else list(own)
            try:
                value = json.loads(said, strict=False) if isinstance(said, str) else None
            except ValueError:
                value = None
            pieces = read_reply([b["type"] for b in own], value)
            kept = [{"source": k, "anchored": True, "type": b["type"], "text": b["text"], "items": b["items"]} for k, b in enumerate(own, 1)]
            out.append((pieces is None, kept if pieces is None else pieces))
        return pd.DataFrame(out, columns=["degraded", "pieces"])

    return run(blocks, reply)


def apply_replies(runs: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """keys, run_id, degraded, pos and the columns of PIECE; runs of blocks (type, text, items) meet (keys, run_id, reply).

    A run without a reply keeps its blocks and is degraded; an empty reply leaves it no rows.
    """
    on = [*keys, "run_id"]
    held = runs.where("run_id is not null").groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("block_index", "type", "text", "items"))).alias("b"))
    own = F.transform("b", lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text"), x["items"].alias("items")))
    read = held.join(replies, on, "left").select(*on, rebuilt(own, F.col("reply")).alias("r"))
    return read.select(*on, "r.degraded", F.posexplode("r.pieces").alias("pos", "p")).select(*on, "degraded", "pos", "p.*")
