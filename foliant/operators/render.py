"""Blocks as Markdown and HTML, and whole books in the formats that can be written.

Blocks carry the columns of a walk and `link`, the address of an image in the output (null where there is none).
"""

from __future__ import annotations

from collections.abc import Callable
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foliant.functions.text import html_escape
from foliant.operators import links as L
from foliant.sources.tree import Node, parse

FORMATS = ("md", "epub", "pdf")
IMAGE = r'<img data-image-id="[^"]+"/>'


def formats(asked: list[str]) -> list[str]:
    """Formats trimmed, in lower case, each once, in order; unknown ones or none at all are an error."""
    out = list(dict.fromkeys(f.strip().lower() for f in asked))
    if unknown := [f for f in out if f not in FORMATS]:
        raise ValueError(f"unknown format {unknown[0]!r}: known are {', '.join(FORMATS)}")
    if not out:
        raise ValueError("no format is asked for")
    return out


def _markdown(node: Node | str, image: Callable[[str], str | None]) -> str:
    if isinstance(node, str):
        return node
    if node.tag == "br":
        return "  \n"
    if node.tag == "img":
        link = image(node.attrs.get("data-image-id", ""))
        return f"![]({link})" if link else ""
    if node.tag == "code":
        return f"`{node.text()}`"
    inner = "".join(_markdown(c, image) for c in node.children)
    if node.tag in ("em", "strong"):
        mark = "*" if node.tag == "em" else "**"
        return f"{mark}{inner}{mark}"
    if node.tag == "a":
        href = node.attrs.get("href")
        return inner if href is None or href.startswith("bbref:") else f"[{inner}]({href})"
    attributes = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attributes}>{inner}</{node.tag}>"


def to_inline_markdown(rich: str, images: dict[str, str]) -> str:
    """Kept markup as Markdown; links inside the book leave their text, what Markdown lacks stays markup."""
    return "".join(_markdown(c, images.get) for c in parse(rich).children)


@F.pandas_udf(T.StringType())
def _inline_markdown(rich: pd.Series, names: pd.Series, links: pd.Series) -> pd.Series:
    said = (None if r is None else to_inline_markdown(r, {} if n is None else dict(zip(n, k))) for r, n, k in zip(rich, names, links))
    return pd.Series(said, dtype=object)


def _has(blocks: DataFrame, name: str) -> bool:
    return name in blocks.columns


def with_inline_markdown(blocks: DataFrame) -> DataFrame:
    """blocks whose text and items are Markdown where they have markup; `links` (image id to address) may be a column."""
    if not _has(blocks, "rich"):
        return blocks
    none = F.array().cast("array<string>")
    names, links = (F.map_keys("links"), F.map_values("links")) if _has(blocks, "links") else (none, none)
    text = F.when(F.col("rich").isNull(), F.col("text")).otherwise(_inline_markdown(F.col("rich"), names, links))
    out = blocks.withColumn("text", text)
    if _has(blocks, "items_rich"):
        joined = F.array_join("items_rich", "\x1e")
        items = F.split(_inline_markdown(F.when(F.col("items_rich").isNotNull(), joined), names, links), "\x1e")
        out = out.withColumn("items", F.when(F.col("items_rich").isNull(), F.col("items")).otherwise(items))
    return out


def block_markdown() -> Column:
    kind, text = F.col("type"), F.col("text")
    marks = F.transform("items", lambda x, i: F.concat(F.when(F.col("ordered"), F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- "), x))
    cell = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.get("rows", F.lit(0)))))
    body = F.transform("rows", row)
    table = F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))), "\n")
    code = F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.regexp_replace(text, r"\n+$", ""), F.lit("\n```"))
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), text))
        .when(kind == "code", code)
        .when(kind == "quote", F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> "))))
        .when(kind == "list", F.array_join(marks, "\n"))
        .when(kind == "table", F.when(F.size("rows") > 0, table).otherwise(""))
        .when(kind == "image", F.concat(F.lit("!["), F.coalesce("caption", F.lit("")), F.lit("]("), "link", F.lit(")")))
        .otherwise(text)
    )


def _attribute(name: str, value: Column, before: str = "") -> Column:
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f' {name}="{before}'), html_escape(value), F.lit('"')))


def inline_html(text: Column, rich: Column, sources: Column | None) -> Column:
    """Kept markup with its images' addresses filled in (sources: image id to address), or the plain text escaped."""
    shown = F.regexp_replace(rich, IMAGE, "")
    if sources is not None:
        parts = F.split(rich, f"(?={IMAGE})|(?<=/>)(?<!<br/>)")
        name = lambda p: F.regexp_extract(p, r'^<img data-image-id="([^"]+)"/>$', 1)
        image = lambda p: F.coalesce(F.concat(F.lit('<img src="'), F.try_element_at(sources, name(p)), F.lit('" alt=""/>')), F.lit(""))
        shown = F.array_join(F.transform(parts, lambda p: F.when(name(p) != "", image(p)).otherwise(p)), "")
    return F.when(rich.isNull(), html_escape(text)).otherwise(shown)


def block_html(blocks: DataFrame) -> Column:
    """A block as HTML: with its anchor and alignment, list markers coloured by a rule of their own."""
    get = lambda c, kind="string": F.col(c) if _has(blocks, c) else F.lit(None).cast(kind)
    sources = F.col("links") if _has(blocks, "links") else None
    kind, text = F.col("type"), inline_html(F.col("text"), get("rich"), sources)
    anchor, align = _attribute("id", get("anchor_id")), _attribute("style", get("align"), "text-align:")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    placed = lambda name, c: F.concat(F.lit(f"<{name}"), anchor, align, F.lit(">"), c, F.lit(f"</{name}>"))
    item = lambda x, i: tag("li", inline_html(x, F.get(get("items_rich", "array<string>"), i), sources))
    items = F.array_join(F.transform("items", item), "")
    row = lambda r, i: tag("tr", F.array_join(F.transform(r, lambda c: F.when(i == 0, tag("th", html_escape(c))).otherwise(tag("td", html_escape(c)))), ""))
    level, caption = F.col("level").cast("string"), html_escape(F.coalesce("caption", F.lit("")))
    figure = F.concat(F.lit("<figure"), align, F.lit('><img src="'), "link", F.lit('" alt="'), caption, F.lit('"/>'), F.when(caption != "", tag("figcaption", caption)).otherwise(""), F.lit("</figure>"))
    colour = get("marker_color")
    slug = F.concat(F.lit("mark-"), F.coalesce(F.nullif(F.regexp_replace(colour, "[^a-zA-Z0-9]+", ""), F.lit("")), F.lit("x")))
    rule = F.when(colour.isNull(), "").otherwise(F.concat(F.lit("<style>."), slug, F.lit(">li::marker{color:"), html_escape(colour), F.lit("}</style>")))
    marked = F.concat(F.when(colour.isNull(), "").otherwise(F.concat(F.lit(' class="'), slug, F.lit('"'))), anchor, _attribute("style", get("marker_type"), "list-style-type:"))
    list_tag = F.when(F.col("ordered"), "ol").otherwise("ul")
    listed = F.concat(rule, F.lit("<"), list_tag, marked, F.lit(">"), items, F.lit("</"), list_tag, F.lit(">"))
    code = F.concat(F.lit("<pre><code"), F.when(F.coalesce("language", F.lit("")) == "", "").otherwise(_attribute("class", F.col("language"), "language-")), F.lit(">"), html_escape(F.col("text")), F.lit("</code></pre>"))
    return (
        F.when(kind == "heading", F.concat(F.lit("<h"), level, anchor, align, F.lit(">"), text, F.lit("</h"), level, F.lit(">")))
        .when(kind == "code", code)
        .when(kind == "quote", placed("blockquote", text))
        .when(kind == "list", listed)
        .when(kind == "table", tag("table", F.array_join(F.transform("rows", row), "")))
        .when(kind == "image", F.when(F.col("link").isNull(), "").otherwise(figure))
        .otherwise(placed("p", text))
    )


def _joined(blocks: DataFrame, keys: list[str], one: Column, by: str, name: str, end: str = "") -> DataFrame:
    held = blocks.withColumn("_one", one).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block_index", "_one")))["_one"].alias("_all"))
    return held.select(*keys, F.concat(F.array_join("_all", by), F.lit(end)).alias(name))


def to_markdown(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks parted by blank lines; needs type, text, level, items, ordered, rows, caption, link, language."""
    return _joined(with_inline_markdown(blocks), keys, block_markdown(), "\n\n", "markdown", "\n")


def to_html(blocks: DataFrame, keys: list[str]) -> DataFrame:
    return _joined(blocks, keys, block_html(blocks), "\n", "html")


def book_parts(blocks: DataFrame, titles: DataFrame, book: list[str], one: Column, heading: Callable[[Column], Column], by: str) -> DataFrame:
    """(book, parts): chapters in order, each of its blocks under its title unless it opens with a heading.

    titles hold (book, chapter, title), also of chapters without blocks.
    """
    keys = [*book, "chapter"]
    first = F.min(F.struct("block_index", "type"))["type"].alias("opens")
    held = blocks.withColumn("_one", one).groupBy(*keys).agg(first, F.array_sort(F.collect_list(F.struct("block_index", "_one")))["_one"].alias("_all"))
    held = titles.join(held, keys, "left").withColumn("_all", F.coalesce("_all", F.array().cast("array<string>")))
    head = F.when((F.coalesce("title", F.lit("")) != "") & (F.coalesce("opens", F.lit("")) != "heading"), F.array(heading(F.col("title")))).otherwise(F.array().cast("array<string>"))
    chapters = held.select(*book, "chapter", F.concat(head, "_all").alias("parts"))
    whole = chapters.groupBy(*book).agg(F.array_sort(F.collect_list(F.struct("chapter", "parts")))["parts"].alias("c"))
    return whole.select(*book, F.filter(F.flatten("c"), lambda p: p.isNotNull()).alias("parts"), F.transform("c", lambda c: F.array_join(c, by)).alias("sections"))


def book_markdown(blocks: DataFrame, titles: DataFrame, books: DataFrame, book: list[str]) -> DataFrame:
    """(book, markdown): the book's title, its chapters' titles and their blocks, parted by blank lines."""
    parts = book_parts(with_inline_markdown(blocks), titles, book, block_markdown(), lambda t: F.concat(F.lit("## "), t), "\n\n")
    held = books.select(*book, F.col("title").alias("_title")).join(parts, book)
    top = F.when(F.coalesce("_title", F.lit("")) != "", F.array(F.concat(F.lit("# "), "_title"))).otherwise(F.array().cast("array<string>"))
    return held.select(*book, F.concat(F.array_join(F.concat(top, "parts"), "\n\n"), F.lit("\n")).alias("markdown"))


CSS = "body{font-family:serif;line-height:1.5}pre{white-space:pre-wrap}img{max-width:100%}table{border-collapse:collapse}td,th{border:1px solid #888;padding:3px}"


def book_html(blocks: DataFrame, titles: DataFrame, books: DataFrame, book: list[str]) -> DataFrame:
    """(book, html): one document with all chapters as sections; books hold (book, title, language)."""
    parts = book_parts(blocks, titles, book, block_html(blocks), lambda t: F.concat(F.lit("<h2>"), html_escape(t), F.lit("</h2>")), "\n")
    held = books.select(*book, F.col("title").alias("_title"), F.col("language").alias("_language")).join(parts, book)
    named = html_escape(F.coalesce("_title", F.lit("")))
    top = F.when(named != "", F.concat(F.lit('<h1 class="book-title">'), named, F.lit("</h1>\n"))).otherwise("")
    sections = F.array_join(F.transform("sections", lambda s: F.concat(F.lit('<section class="chapter">\n'), s, F.lit("\n</section>"))), "\n")
    head = F.concat(F.lit('<!DOCTYPE html>\n<html lang="'), html_escape(F.coalesce("_language", F.lit("en"))), F.lit('">\n<head><meta charset="utf-8"><title>'), named, F.lit(f"</title><style>{CSS}</style></head>\n<body>\n"))
    return held.select(*book, F.concat(head, top, sections, F.lit("\n</body>\n</html>\n")).alias("html"))


def data_uri(mime: Column, content: Column) -> Column:
    """Bytes as an address of their own."""
    return F.concat(F.lit("data:"), F.coalesce(F.nullif(mime, F.lit("")), F.lit("application/octet-stream")), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def with_links(blocks: DataFrame, addresses: DataFrame, book: list[str]) -> DataFrame:
    """blocks with `link` and `links`, the addresses of the images that they show; addresses hold (book, image_id, address)."""
    from foliant.sources.html import block_image_ids

    keys = [*book, "chapter", "block_index"]
    shown = blocks.select(*keys, F.explode(F.array_distinct(block_image_ids())).alias("image_id")).join(addresses, [*book, "image_id"])
    links = shown.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("image_id", "address"))).alias("links"))
    held = blocks.join(links, keys, "left").withColumn("links", F.coalesce("links", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    return held.withColumn("link", F.when(F.col("type") == "image", F.try_element_at("links", F.col("image_id"))))


def pdf_writer() -> Callable[[str], bytes]:
    """Turns a document of HTML into PDF with a library, if there is one."""
    try:
        from weasyprint import HTML
    except (ImportError, OSError) as e:
        raise RuntimeError("PDF output needs the library weasyprint and what it builds on") from e
    return lambda html: HTML(string=html).write_pdf()


def each(asked: list[str], writers: dict[str, Callable[[], object]]) -> tuple[dict[str, object], list[str]]:
    """(what each format's writer made, warnings): a format that can't be written here leaves the others alone."""
    made, warnings = {}, []
    for name in formats(asked):
        try:
            made[name] = writers[name]()
        except RuntimeError as e:
            warnings.append(f"{name}: skipped: {e}")
    return made, warnings


def plain_links(blocks: DataFrame) -> DataFrame:
    """blocks without links inside the book."""
    return blocks.withColumn("rich", L.unresolved(F.col("rich"))) if _has(blocks, "rich") else blocks


