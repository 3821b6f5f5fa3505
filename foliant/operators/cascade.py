"""Style sheets of books as relations: declarations of classes, of which the last one wins property by property.

sheets: (book, sheet, css), sheet being the place of a sheet in its book. Rules, selectors and declarations are taken
apart by splits at braces, commas and semicolons, all in the JVM; only rules whose selector is a single class count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions import styles as S
from foliant.functions.text import strip

#: The form of a colour that may be written out, as `functions.styles` has it.
COLOUR = S.COLOUR.pattern


def rules(sheets: DataFrame) -> DataFrame:
    """(book, sheet, rule, selectors, body): innermost rules in order, without comments."""
    bare = F.regexp_replace("css", r"(?s)/\*.*?\*/", " ")
    parts = sheets.select("book", "sheet", F.split(bare, r"\{").alias("p"))
    # A body reaches to the brace that ends it; its selectors follow the last one that ended before.
    rule = lambda i: F.struct(
        F.substring_index(F.get("p", i - 1), "}", -1).alias("selectors"),
        F.when(F.contains(F.get("p", i), F.lit("}")), F.substring_index(F.get("p", i), "}", 1)).alias("body"),
    )
    numbers = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: i > 0)
    each = parts.select("book", "sheet", F.posexplode(F.transform(numbers, rule)).alias("rule", "r"))
    return each.select("book", "sheet", "rule", "r.*").where("body is not null and selectors != ''")


def signal(name: Column, value: Column) -> Column:
    """Struct (signal, value) of one declaration; null if it says nothing that the engine keeps."""
    said = lambda what, of: F.struct(F.lit(what).alias("signal"), of.cast("string").alias("value"))
    one = F.lit("1")
    plain = strip(value)
    colour = plain.rlike(f"^(?:{COLOUR})$") & ~F.contains(plain, F.lit("url")) & ~F.contains(plain, F.lit("expression"))
    marks = F.transform(F.filter(F.split(F.replace(value, F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != ""), marker)
    first = F.get(F.filter(marks, lambda m: m.isNotNull()), F.lit(0))
    kind = marker(F.get(F.filter(F.split(value, r"\s+"), lambda w: w != ""), F.lit(0)))
    return (
        F.when((name == "font-style") & F.contains(value, F.lit("italic")), said("italic", one))
        .when((name == "font-weight") & (F.contains(value, F.lit("bold")) | value.isin(*S.HEAVY)), said("bold", one))
        .when((name == "text-decoration") & F.contains(value, F.lit("line-through")), said("strike", one))
        .when((name == "text-align") & value.isin(*S.ALIGNMENTS), said("align", value))
        .when((name == "color") & colour, said("color", plain))
        .when((name == "list-style-type") & kind.isNotNull(), said("marker", kind))
        .when((name == "list-style") & first.isNotNull(), said("marker", first))
        .when((name == "list-style-image") & ~value.isin("", "none"), said("marker", F.lit("square")))
    )


def marker(word: Column) -> Column:
    """The list marker that a word names; a picture counts as a square."""
    return F.when(F.startswith(word, F.lit("url(")), "square").when(word.isin(*S.MARKERS), word)


def declarations(sheets: DataFrame) -> DataFrame:
    """(book, class, signal, value, at): what sheets say of classes, `at` telling the order."""
    said = rules(sheets).select("book", "sheet", "rule", F.split("selectors", ",").alias("s"), F.posexplode(F.split(F.lower("body"), ";")).alias("place", "d"))
    name, value = strip(F.substring_index("d", ":", 1)), strip(F.regexp_extract("d", "(?s)^[^:]*:(.*)$", 1))
    said = said.where(F.contains("d", F.lit(":"))).select("book", "sheet", "rule", "place", "s", signal(name, value).alias("x")).where("x is not null")
    each = said.select("book", F.struct("sheet", "rule", "place").alias("at"), "x.*", F.explode("s").alias("selector"))
    own = F.regexp_extract(strip(F.col("selector")), f"^{S.CLASS_SELECTOR.pattern}$", 1)
    return each.select("book", own.alias("class"), "signal", "value", "at").where("class != ''")


def class_styles(sheets: DataFrame) -> DataFrame:
    """(book, class, styles): for each class a map of signals; of a signal's declarations the last one wins.

    Last are those of later sheets, and in a sheet those that stand later. Partial maxima come before the shuffle.
    """
    last = declarations(sheets).groupBy("book", "class", "signal").agg(F.max_by("value", "at").alias("value"))
    pairs = F.array_sort(F.collect_list(F.struct("signal", "value")))
    return last.groupBy("book", "class").agg(F.map_from_entries(pairs).alias("styles"))
