"""Queries over places, links and style sheets of books as relations. Documents are pages of the book of their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliant.functions import text as T
from foliant.operators import anchors as A, blocks as B, cascade as S, long_chapters as LC
from foliant.plans import catalogue as C

query = C.query

# Every third line is a named element; its name is its first word, so that many come back. Every 7th is a heading.
_ELEMENTS = f"""WITH {C.LINES}, pages AS (SELECT source AS book, doc_id AS spine, 'text/' || (doc_id % 4) || '/' || doc_id || '.xhtml' AS path FROM documents),
  words AS (SELECT l.book, l.chapter AS spine, p.path, l.block_index AS pos, l.text, list_filter(string_split_regex(l.text, '[^A-Za-z]+'), lambda x: x <> '')[1] AS word
    FROM lines l JOIN pages p ON p.spine = l.chapter),
  elements AS (SELECT *, CASE WHEN pos % 7 = 0 THEN 'h2' ELSE 'p' END AS tag FROM words WHERE pos % 3 = 0 AND spine % 5 > 0 AND word IS NOT NULL),
  named AS (SELECT book, path, word AS place, min((spine, pos)) AS o, arg_min(tag, (spine, pos)) = 'h2' AS heading FROM elements GROUP BY ALL),
  spare AS (SELECT book, path, NULL AS place, (spine, {A.LAST}) AS o, false AS heading FROM pages ANTI JOIN named USING (book, path)),
  anchors AS (SELECT *, 'a' || row_number() OVER (PARTITION BY book ORDER BY o) AS anchor_id FROM (SELECT * FROM named UNION ALL SELECT * FROM spare))"""


def _pages(spark, d) -> DataFrame:
    path = F.concat(F.lit("text/"), (F.col("doc_id") % 4).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".xhtml"))
    return C.docs(spark, d).select(F.col("source").alias("book"), F.col("doc_id").alias("spine"), path.alias("path"), "text")


def _lines(spark, d) -> DataFrame:
    word = F.get(F.filter(F.split("text", "[^A-Za-z]+"), lambda x: x != ""), F.lit(0))
    flat = _pages(spark, d).select("book", "spine", "path", F.posexplode(T.lines_of(F.col("text"))).alias("pos", "text"))
    return flat.withColumn("word", word)


def _anchors(spark, d) -> DataFrame:
    named = _lines(spark, d).where("pos % 3 = 0 and spine % 5 > 0")
    elements = named.select("book", "spine", "path", "pos", F.when(F.col("pos") % 7 == 0, "h2").otherwise("p").alias("tag"), F.col("word").alias("place"))
    return A.anchor_table(elements, _pages(spark, d).drop("text"))


@query(f"{_ELEMENTS} SELECT book, path, place, heading, anchor_id FROM anchors")
def anchor_index(spark, d):
    """Names of places in the order of the spine; a book of any size is numbered by many tasks."""
    return _anchors(spark, d).select("book", "path", "place", "heading", "anchor_id")


@query(f"{_ELEMENTS} SELECT book, path, arg_min(anchor_id, (NOT heading, o[2])) AS anchor_id FROM anchors GROUP BY ALL")
def page_anchor_targets(spark, d):
    return A.page_targets(_anchors(spark, d))


# Every fifth line is a link: by its number to a place of its page, of another one, to a page, outside, or to nowhere.
_HREF = """CASE (pos // 5) % 8 WHEN 0 THEN '#' || word WHEN 1 THEN '../' || ((spine + 1) % 4) || '/' || (spine + 1) || '.xhtml#' || word
  WHEN 2 THEN '../' || ((spine + 1) % 4) || '/' || (spine + 1) || '.xhtml' WHEN 3 THEN 'HTTPS://example.com/' || word WHEN 4 THEN '../../../' || word
  WHEN 5 THEN './%2E/' || spine || '.xhtml#' || word || '?x' WHEN 6 THEN '#' ELSE '/' || word END"""


@query(f"""{_ELEMENTS}, links AS (SELECT book, spine, path, pos, word, {_HREF} AS href, (pos // 5) % 8 AS kind FROM words WHERE pos % 5 = 0 AND word IS NOT NULL),
  targets AS (SELECT book, path, arg_min(anchor_id, (NOT heading, o[2])) AS anchor_id FROM anchors GROUP BY ALL),
  aimed AS (SELECT *, CASE WHEN kind IN (0, 5) THEN path WHEN kind IN (1, 2) THEN 'text/' || ((spine + 1) % 4) || '/' || (spine + 1) || '.xhtml' END AS to_path,
    CASE WHEN kind IN (0, 1, 5) THEN word END AS to_place FROM links)
  SELECT l.book, l.path, l.pos, l.href, CASE WHEN kind = 3 THEN href WHEN kind = 2 THEN 'bbref:' || t.anchor_id ELSE 'bbref:' || a.anchor_id END AS target
  FROM aimed l LEFT JOIN anchors a ON a.book = l.book AND a.path = l.to_path AND a.place = l.to_place
  LEFT JOIN targets t ON t.book = l.book AND t.path = l.to_path""")
def href_targets(spark, d):
    """Links joined to the places and pages that they name; those that leave the archive or name nothing have no target."""
    n, word = F.floor(F.col("pos") / 5) % 8, F.col("word")
    other = F.concat(F.lit("../"), ((F.col("spine") + 1) % 4).cast("string"), F.lit("/"), (F.col("spine") + 1).cast("string"), F.lit(".xhtml"))
    href = (
        F.when(n == 0, F.concat(F.lit("#"), word)).when(n == 1, F.concat(other, F.lit("#"), word)).when(n == 2, other)
        .when(n == 3, F.concat(F.lit("HTTPS://example.com/"), word)).when(n == 4, F.concat(F.lit("../../../"), word))
        .when(n == 5, F.concat(F.lit("./%2E/"), F.col("spine").cast("string"), F.lit(".xhtml#"), word, F.lit("?x")))
        .when(n == 6, F.lit("#")).otherwise(F.concat(F.lit("/"), word))
    )
    links = _lines(spark, d).where("pos % 5 = 0 and word is not null").select("book", "path", "pos", href.alias("href"))
    return A.resolved(links, _anchors(spark, d))


# Sheets of books are made of parts: each part is a rule for its brand's class, and sheets hold a hundred parts.
_COLOURS = ("red", "#0af", "rgb(1, 2, 3)", "url(x)", "12px")
_VALUE = """CASE p_partkey % 9 WHEN 0 THEN ['italic', '1'] WHEN 1 THEN CASE WHEN p_size * 20 IN (600, 700, 800, 900) THEN ['bold', '1'] END WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN ['align', 'center'] END
  WHEN 3 THEN CASE WHEN p_size % 5 < 3 THEN ['color', ['red', '#0af', 'rgb(1, 2, 3)'][p_size % 5 + 1]] END WHEN 4 THEN ['strike', '1'] WHEN 5 THEN ['marker', 'circle'] WHEN 6 THEN ['marker', 'disc'] END"""


@query(f"""WITH p AS (SELECT p_partkey % 7 AS book, p_partkey // 7 // 100 AS sheet, p_partkey AS pos, 'b' || replace(p_brand, 'Brand#', '') AS class, p_partkey % 11 = 10 AS other, {_VALUE} AS v FROM part),
  last AS (SELECT book, class, v[1] AS signal, arg_max(v[2], (sheet, pos)) AS value FROM p WHERE NOT other AND v IS NOT NULL GROUP BY ALL)
  SELECT book, class, string_agg(signal || '=' || value, ';' ORDER BY signal) AS styles FROM last GROUP BY ALL""")
def style_cascade(spark, d):
    """Styles of classes over all sheets of a book; of every 11th rule the selector is more than a class."""
    size, key = F.col("p_size"), F.col("p_partkey")
    kind = key % 9
    colour = F.element_at(F.array(*map(F.lit, _COLOURS)), (size % 5 + 1).cast("int"))
    said = (
        F.when(kind == 0, "font-style: Italic").when(kind == 1, F.concat(F.lit("font-weight: "), (size * 20).cast("string")))
        .when(kind == 2, F.concat(F.lit("text-align:"), F.when(size % 2 == 0, "center").otherwise("justify"))).when(kind == 3, F.concat(F.lit("color: "), colour))
        .when(kind == 4, "text-decoration: underline line-through").when(kind == 5, F.concat(F.lit("list-style: inside "), "p_type", F.lit(" circle")))
        .when(kind == 6, "list-style-type: disc").when(kind == 7, "list-style-image: none").otherwise("margin: 0")
    )
    name = F.concat(F.lit(".b"), F.replace("p_brand", F.lit("Brand#"), F.lit("")))
    selector = F.when(key % 11 == 10, F.concat(F.lit("div "), name)).otherwise(F.concat(name, F.lit(", p > a")))
    rule = F.concat(selector, F.lit(" { /* { */ "), said, F.lit("; x } "))
    parts = C.table(spark, d, "part").select((key % 7).alias("book"), F.floor(F.floor(key / 7) / 100).alias("sheet"), key.alias("at"), rule.alias("rule"))
    sheets = parts.groupBy("book", "sheet").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "rule")))["rule"], "\n").alias("css"))
    pairs = F.transform(F.array_sort(F.map_entries("styles")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return S.class_styles(sheets).select("book", "class", F.array_join(pairs, ";").alias("styles"))


@query(f"""WITH RECURSIVE {C.LINES}, n AS (SELECT book, chapter, block_index, tokens, row_number() OVER (PARTITION BY book ORDER BY chapter, block_index) AS i FROM lines), greedy AS (
  SELECT book, chapter, block_index, i, tokens AS held, 1 AS chunk_no FROM n WHERE i = 1
  UNION ALL SELECT n.book, n.chapter, n.block_index, n.i, CASE WHEN g.held + n.tokens > {C.CHUNK} THEN n.tokens ELSE g.held + n.tokens END,
    CASE WHEN g.held + n.tokens > {C.CHUNK} THEN g.chunk_no + 1 ELSE g.chunk_no END FROM greedy g JOIN n ON n.book = g.book AND n.i = g.i + 1)
  SELECT book, chapter, block_index, chunk_no FROM greedy""")
def book_chunks(spark, d):
    """Chunks over whole books, whose blocks are too many for an array: by pointers and doubling."""
    blocks = B.paragraphs(C.docs(spark, d)).select("book", "chapter", "block_index", "tokens")
    return LC.chunk_table(blocks, ["book"], ["chapter", "block_index"], C.CHUNK).drop("tokens")
