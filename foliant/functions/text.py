"""Scalar expressions over text: all built-in functions, so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Language names and their primary tags.
LANGUAGE_TAGS = {
    "english": "en", "spanish": "es", "español": "es", "espanol": "es", "french": "fr", "français": "fr", "francais": "fr", "german": "de",
    "deutsch": "de", "portuguese": "pt", "português": "pt", "portugues": "pt", "italian": "it", "italiano": "it", "dutch": "nl",
    "nederlands": "nl", "japanese": "ja", "chinese": "zh", "korean": "ko", "russian": "ru", "arabic": "ar", "hindi": "hi", "polish": "pl",
    "turkish": "tr", "swedish": "sv", "norwegian": "no", "danish": "da", "finnish": "fi", "greek": "el", "hebrew": "he", "czech": "cs",
    "romanian": "ro", "hungarian": "hu", "thai": "th", "vietnamese": "vi", "indonesian": "id", "catalan": "ca", "ukrainian": "uk",
}


# Fixed value: the form of a language code.
CODE = r"^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*$"


def strip(c: Column) -> Column:
    """Without white space, in Unicode's sense, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def count_tokens(c: Column) -> Column:
    """A quarter of the code points, 1 at least; 0 for the empty text, null for null."""
    return F.when(c == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int")))


def split_paragraphs(c: Column) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, r"(?U)\n\s*\n"), strip), lambda p: p != "")


def lines_of(c: Column) -> Column:
    """Lines that hold more than spaces, in order."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda line: F.trim(line) != "")


def fingerprint(*fields: Column) -> Column:
    """SHA-1 of the fields, each closed by a zero byte, so that no two lists of fields run together."""
    return F.sha1(F.concat(*(x for f in fields for x in (f.cast("string"), F.lit("\0")))))


def block_text(kind: Column, text: Column, items: Column, rows: Column, caption: Column) -> Column:
    """The text of a block of any type: list items by line, table rows by line with cells by space, image captions."""
    table = F.array_join(F.transform(rows, lambda r: F.array_join(r, " ")), "\n")
    return F.when(kind == "list", F.array_join(items, "\n")).when(kind == "table", table).when(kind == "image", F.coalesce(caption, F.lit(""))).otherwise(text)


def to_bcp47(c: Column) -> Column:
    """Tag of a language name or code; `und` for anything else."""
    tags = F.create_map(*(F.lit(x) for kv in LANGUAGE_TAGS.items() for x in kv))
    raw = strip(c)
    code = F.replace(raw, F.lit("_"), F.lit("-"))
    named = F.lower(code)
    first = F.regexp_replace(F.regexp_extract(named, r"^(\S*)", 1), r"^[()]+|[()]+$", "")
    dash = F.instr(code, "-")
    tidy = F.when(dash > 0, F.concat(F.lower(F.substr(code, F.lit(1), dash - 1)), F.substr(code, dash))).otherwise(F.lower(code))
    coded = F.when(code.rlike(CODE), tidy).otherwise("und")
    return F.coalesce(F.try_element_at(tags, named), F.try_element_at(tags, first), coded)


def json_object(c: Column) -> Column:
    """From the first opening to the last closing brace, as a variant; null if that isn't a JSON object."""
    span = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(F.when(span != "", span))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def html_escape(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def image_filename(path: Column, image_id: Column, extension: Column) -> Column:
    """Base name of the path, or the id, in safe characters, with an extension."""
    base = F.coalesce(F.nullif(F.regexp_extract(path, r"([^/]*)$", 1), F.lit("")), F.concat(image_id, extension))
    safe = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]", "_"), r"^\.+", "")
    named = F.when(safe == "", "image").otherwise(safe)
    return F.when(F.contains(named, F.lit(".")), named).otherwise(F.concat(named, extension))
