"""Places that links within a book can point at, and what its links resolve to, as relations.

elements: (book, spine, path, pos, tag, place), the named elements of pages, in the order of the spine and of the page.
pages: (book, spine, path), all pages. links: (book, path, href and whatever else).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions.text import strip
from foliant.operators.numbering import numbered_within
from foliant.workspace import Workspace

# What begins the address of something outside the book, and the tags of headings.
EXTERNAL = ("http://", "https://", "mailto:")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Behind every element of a page.
LAST = 1 << 62


def anchor_table(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(book, path, place, pos, heading, anchor_id): names a1, a2, ... in the order in which places are first seen.

    A name that a page has several times stands for its first element. A page without a named element gets one place,
    null, behind everything on it, as a link may point at the file. A path that the spine has several times counts
    where it comes first.
    """
    key = ["book", "path", "place"]
    named = elements.where("place is not null").groupBy(*key).agg(F.min(F.struct("spine", "pos", "tag")).alias("f"))
    named = named.select(*key, F.col("f.spine").alias("spine"), F.col("f.pos").cast("long").alias("pos"), F.col("f.tag").isin(*HEADINGS).alias("heading"))
    first = pages.groupBy("book", "path").agg(F.min("spine").alias("spine"))
    bare = first.join(named.select("book", "path").distinct(), ["book", "path"], "left_anti")
    spare = bare.select("book", "path", F.lit(None).cast("string").alias("place"), "spine", F.lit(LAST).alias("pos"), F.lit(False).alias("heading"))
    work = Workspace(elements.sparkSession, "anchors")
    held = numbered_within(work, named.unionByName(spare), ["book"], ["spine", "pos"])
    return held.select(*key, "spine", "pos", "heading", F.concat(F.lit("a"), (F.col("_n") + 1).cast("string")).alias("anchor_id"))


def page_targets(anchors: DataFrame) -> DataFrame:
    """(book, path, anchor_id): what a link to a whole page means: its first heading with a name, else its first place."""
    return anchors.groupBy("book", "path").agg(F.min_by("anchor_id", F.struct(~F.col("heading"), "pos")).alias("anchor_id"))


def unquoted(text: Column) -> Column:
    """A text with its percent signs resolved; one that they don't fit stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def inside(base: Column, file: Column) -> Column:
    """Path of a reference from the file base; null if it leaves the archive.

    The parts of the path are folded one after the other: two dots take the last one off, if there's one.
    """
    parts = F.split(base, "/")
    none = F.array().cast("array<string>")
    start = F.struct(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))).alias("at"), F.lit(True).alias("sound"))

    def step(state: Column, part: Column) -> Column:
        up, skip, n = part == "..", part.isin("", "."), F.size(state["at"])
        at = F.when(up, F.slice(state["at"], 1, F.greatest(n - 1, F.lit(0)))).when(skip, state["at"]).otherwise(F.array_append(state["at"], part))
        return F.struct(at.alias("at"), (state["sound"] & ~(up & (n == 0))).alias("sound"))

    made = F.aggregate(F.coalesce(F.split(file, "/"), none), start, step)
    nothing = (F.size(made["at"]) == 0) & F.contains(file, F.lit(".."))
    return F.when(made["sound"] & ~F.startswith(file, F.lit("/")) & ~nothing, F.array_join(made["at"], "/"))


def resolved(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """links with `target`: addresses outside the book as they are, bbref: and an anchor's name for known places and pages,
    null for all others, which leave only their text."""
    external = F.lower("href").rlike("^(" + "|".join(EXTERNAL) + ")")
    file, place = F.substring_index("href", "#", 1), F.when(F.contains("href", F.lit("#")), F.regexp_extract("href", "#(.*)", 1)).otherwise("")
    place = strip(unquoted(F.substring_index(place, "?", 1)))
    name = unquoted(F.regexp_extract(file, r"^[^?#]*", 0))
    held = links.withColumns({"_external": F.coalesce(external, F.lit(False)), "_place": place, "_file": file})
    held = held.withColumn("_path", F.when(F.col("_file") == "", F.col("path")).otherwise(inside(F.col("path"), name)))
    # Links to a place and links to a page are two joins by equality.
    at = anchors.where("place is not null").select("book", F.col("path").alias("_path"), F.col("place").alias("_place"), F.col("anchor_id").alias("_at"))
    pages = page_targets(anchors).select("book", F.col("path").alias("_path"), F.col("anchor_id").alias("_page"))
    held = held.join(at, ["book", "_path", "_place"], "left").join(pages, ["book", "_path"], "left")
    found = F.when(F.col("_place") != "", F.col("_at")).when(F.col("_file") != "", F.col("_page"))
    target = F.when(F.col("_external"), F.col("href")).when(found.isNotNull(), F.concat(F.lit("bbref:"), found))
    return held.withColumn("target", target).select(*links.columns, "target")
