"""The rules of `operators.replies` as columns: replies are variants, and a run's pieces come from higher-order functions.

No Python worker takes part, so replies that lie in a table already, as those of an earlier run do, are read where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions.text import strip

PIECE = "struct<source: int, anchored: boolean, type: string, text: string, items: array<string>>"


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))


def _field(entry: Column, name: str) -> Column:
    return F.try_variant_get(entry, f"$.{name}", "variant")


def _array(value: Column) -> Column:
    """The values of a variant that is an array; null for any other."""
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.try_variant_get(value, "$", "array<variant>"))


def ordinal(entry: Column) -> Column:
    """The block that an entry names by a whole number or its digits; a truth value is no number."""
    named = _field(entry, "block")
    digits = strip(named.try_cast("string"))
    return F.when(_is(named, "BIGINT") | (_is(named, "STRING") & digits.rlike("^[0-9]+$")), digits.try_cast("int"))


def _said(value: Column) -> Column:
    """An item as text, in the form that a reply's own language gives to truth values and nothing."""
    text = value.try_cast("string")
    return strip(F.when(_is(value, "BOOLEAN"), F.initcap(text)).when(_is(value, "VOID"), F.lit("None")).otherwise(text))


def _content(kind: Column, entry: Column) -> Column:
    """Struct (text, items) of an entry for a block of a kind; null if it has none or is of another kind."""
    type_ = _field(entry, "type")
    own = F.when(_is(type_, "STRING"), type_.try_cast("string"))
    plain = kind == "paragraph"
    fits = F.when(plain, type_.isNull() | _is(type_, "VOID") | F.coalesce(own == kind, F.lit(False))).otherwise(F.coalesce(own == kind, F.lit(False)))
    bare = plain & _is(entry, "STRING")
    given = F.when(bare, entry).when(fits & F.startswith(F.schema_of_variant(entry), F.lit("OBJECT")), _field(entry, "text"))
    text = F.when(_is(given, "STRING"), strip(given.try_cast("string")))
    items = F.when(fits, F.filter(F.transform(_array(_field(entry, "items")), _said), lambda x: x != ""))
    struct = lambda t, i: F.struct(t.cast("string").alias("text"), i.cast("array<string>").alias("items"))
    nothing = F.lit(None)
    return F.when((kind == "list") & (F.size(items) > 0), struct(nothing, items)).when((kind != "list") & (text != ""), struct(text, nothing))


def with_pieces(rows: DataFrame, kinds: str, reply: str, out: str = "pieces") -> DataFrame:
    """rows with an array of PIECE for a run of blocks of kinds (a column's name); null if the reply can't stand for them.

    What several rules look at is a column of its own for a while, so that it is worked out once for each run.
    """
    value, n, k = F.col("_value"), F.size(kinds), F.col(kinds)
    string = F.col("_string")
    held = rows.withColumn("_value", F.try_parse_json(reply)).withColumn("_string", _is(value, "STRING")).withColumn("_plain", F.forall(k, lambda x: x == "paragraph"))
    parts = F.filter(F.transform(F.split(value.try_cast("string"), r"\n\s*\n"), strip), lambda p: p != "")
    entries = F.when(string & F.col("_plain"), F.transform(parts, lambda p: p.cast("variant"))).when(~string, _array(value))
    held = held.withColumn("_entries", entries).withColumn("_named", F.transform("_entries", ordinal))
    named, count = F.col("_named"), F.size("_entries")
    addressed = (count > 0) & F.forall(named, lambda x: x.isNotNull())
    known = F.forall(named, lambda s: s.between(1, n)) & (named == F.array_sort(named))
    numbers = F.sequence(F.lit(1), n)
    whole = F.forall(numbers, lambda i: (F.element_at(k, i) == "paragraph") | (F.size(F.filter(named, lambda s: s == i)) == 1))
    none = F.array_repeat(F.lit(0), count)
    sources = (
        F.when(string, F.when((count == 1) & (n == 1), F.array(F.lit(1))).otherwise(none)).when(addressed, F.when(known & whole, named))
        .when(count == n, F.when(n > 0, numbers).otherwise(F.array().cast("array<int>"))).when(F.col("_plain"), none)
    )
    held = held.withColumn("_sources", F.when(F.col("_entries").isNotNull(), sources))

    def piece(pair: Column, at: Column) -> Column:
        source = pair["_sources"]
        kind = F.when(source > 0, F.try_element_at(k, source)).otherwise("paragraph")
        # The first piece of a split block keeps its anchor: an anchor names one place.
        first = (source > 0) & (F.array_position("_sources", source) == at + 1)
        return F.struct(F.when(source > 0, source).cast("int").alias("source"), first.alias("anchored"), kind.alias("type"), _content(kind, pair["_entries"]).alias("held"))

    held = held.withColumn("_pieces", F.transform(F.arrays_zip("_entries", "_sources"), piece))
    flat = lambda p: F.struct(p["source"].alias("source"), p["anchored"].alias("anchored"), p["type"].alias("type"), p["held"]["text"].alias("text"), p["held"]["items"].alias("items"))
    sound = F.col("_sources").isNotNull() & F.forall("_pieces", lambda p: p["held"].isNotNull())
    return held.withColumn(out, F.when(sound, F.transform("_pieces", flat))).select(*(c for c in rows.columns if c != out), out)


def with_rebuilt(rows: DataFrame, blocks: str, reply: str) -> DataFrame:
    """rows with degraded and pieces of a run: blocks is an array of (type, text, items), reply the JSON of its value."""
    held = with_pieces(rows.withColumn("_kinds", F.transform(blocks, lambda b: b["type"])), "_kinds", reply)
    own = F.transform(
        blocks,
        lambda b, i: F.struct((i + 1).alias("source"), F.lit(True).alias("anchored"), b["type"].alias("type"), b["text"].alias("text"), b["items"].alias("items")),
    )
    done = held.withColumn("degraded", F.col("pieces").isNull()).withColumn("pieces", F.coalesce("pieces", own))
    return done.drop("_kinds")
