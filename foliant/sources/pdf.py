"""PDF books as rows. What reads the bytes is a plug-in: a function from bytes to `Extracted`; the rest is relational.

No library that lays out PDF text is part of this package. `extractor()` finds one that is installed, or raises.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions.provider import Provider
from foliant.functions.text import strip

LINES = "page int, line_no int, top double, bottom double, text string, font string, size double"
TABLES = "page int, top double, bottom double, rows array<array<string>>"
PICTURES = "page int, pos int, name string, data binary"
PAGES = 20
# Types of images by their extension.
MIMES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tiff": "image/tiff", "jp2": "image/jp2"}
TOC_SYSTEM = "You find the chapters in the first pages of a book, and name only those that you are sure of."


@dataclass
class Extracted:
    """Of one book: lines as (top, bottom, text, characters as (font, size)), tables and images page by page."""

    title: str | None = None
    author: str | None = None
    outline: list[tuple[str, int]] = field(default_factory=list)
    lines: list[list[tuple[float, float, str, list[tuple[str, float | None]]]]] = field(default_factory=list)
    tables: list[list[tuple[float, float, list[list[str | None]]]]] = field(default_factory=list)
    images: list[list[tuple[str, bytes]] | None] = field(default_factory=list)


def extractor() -> Callable[[bytes], Extracted]:
    """Reads PDF bytes with a library, if there is one."""
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF needs the library pdfplumber; or pass an extractor of your own") from e
    import io

    def extract(data: bytes) -> Extracted:
        out = Extracted()
        with pdfplumber.open(io.BytesIO(data)) as book:
            out.title, out.author = (book.metadata or {}).get("Title"), (book.metadata or {}).get("Author")
            for page in book.pages:
                out.lines.append([(x["top"], x["bottom"], x["text"], [(c.get("fontname", ""), c.get("size")) for c in x.get("chars") or []]) for x in page.extract_text_lines()])
                out.tables.append([(t.bbox[1], t.bbox[3], t.extract()) for t in page.find_tables()])
                out.images.append([])
        return out

    return extract


def dominant(chars: list[tuple[str, float | None]]) -> tuple[str, float]:
    """The most frequent font, the first met among equals, and the median size of characters that have one."""
    sizes = [float(s) for _, s in chars if s]
    fonts = Counter(f for f, _ in chars).most_common(1)
    return fonts[0][0] if fonts else "", median(sizes) if sizes else 0.0


def line_rows(book: Extracted) -> Iterator[tuple]:
    for page, held in enumerate(book.lines):
        for n, (top, bottom, text, chars) in enumerate(held):
            yield page, n, float(top), float(bottom), text.strip(), *dominant(chars)


def table_rows(book: Extracted) -> Iterator[tuple]:
    """Tables with cells stripped, without rows that are empty all through."""
    for page, held in enumerate(book.tables):
        for top, bottom, cells in held:
            rows = [r for r in ([(c or "").strip() for c in row] for row in cells) if any(r)]
            if rows:
                yield page, float(top), float(bottom), rows


def image_rows(book: Extracted) -> Iterator[tuple]:
    for page, held in enumerate(book.images):
        for pos, (name, data) in enumerate(held or ()):  # a page whose images can't be read has none
            yield page, pos, name, data


def _rows(books: DataFrame, schema: str, rows, extract: Callable[[bytes], Extracted]) -> DataFrame:
    names = ["doc", *(f.split()[0] for f in schema.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(d, *r) for d, data in zip(frame["doc"], frame["content"]) if data is not None for r in rows(extract(data))], columns=names)

    return books.select("doc", "content").mapInPandas(run, f"doc {dict(books.dtypes)['doc']}, {schema}")


def read_lines(books: DataFrame, extract: Callable[[bytes], Extracted]) -> DataFrame:
    """doc and the columns of LINES for books (doc, content)."""
    return _rows(books, LINES, line_rows, extract)


def read_tables(books: DataFrame, extract: Callable[[bytes], Extracted]) -> DataFrame:
    return _rows(books, TABLES, table_rows, extract)


def read_images(books: DataFrame, extract: Callable[[bytes], Extracted]) -> DataFrame:
    return _rows(books, PICTURES, image_rows, extract)


def read_metadata(books: DataFrame, extract: Callable[[bytes], Extracted]) -> DataFrame:
    """doc, title (the file's stem where there's none), author, outline (title, start_page) of the top level, pages."""

    def rows(book: Extracted) -> Iterator[tuple]:
        yield book.title or None, book.author or None, [{"title": t, "start_page": p} for t, p in book.outline], len(book.lines)

    names = ["doc", "title", "author", "outline", "pages"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(d, *r) for d, data in zip(frame["doc"], frame["content"]) if data is not None for r in rows(extract(data))], columns=names)

    found = books.select("doc", "content").mapInPandas(run, f"doc {dict(books.dtypes)['doc']}, title string, author string, outline array<struct<title: string, start_page: int>>, pages int")
    return found.withColumn("title", F.coalesce("title", file_stem(F.col("doc").cast("string"))))


def file_stem(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def image_mime(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MIMES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))), F.lit("image/png"))


def page_texts(lines: DataFrame) -> DataFrame:
    """(doc, page, text): a page's lines, by line."""
    held = lines.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return held.select("doc", "page", F.array_join("l.text", "\n").alias("text"))


def toc_samples(pages: DataFrame, most: int = PAGES) -> DataFrame:
    """(doc, n_pages, sample): the first pages of each book under [PAGE n] marks; books without pages have none."""
    first = pages.where(F.col("page") < most)
    held = first.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    part = F.transform("p", lambda p: F.concat(F.lit("[PAGE "), p["page"].cast("string"), F.lit("]\n"), p["text"]))
    return held.select("doc", F.size("p").alias("n_pages"), F.array_join(part, "\n\n").alias("sample"))


def toc_prompt(n_pages: Column, sample: Column) -> Column:
    return F.concat(
        F.lit("Here are the first "), n_pages.cast("string"), F.lit(' pages of a book, each after its [PAGE k] mark. Return only {"chapters": [{"title": "...", '
        '"start_page": k}]}, with k the page on which a chapter begins, and an empty list if none are clear.\n\n'), sample,
    )


def read_toc(raw: str) -> list[tuple[str, int]]:
    """Entries of a reply; malformed ones fall away, a reply without a JSON object fails."""
    span = re.search(r"(?s)\{.*\}", raw or "")
    said = json.loads(span[0], strict=False) if span else None
    if not isinstance(said, dict):
        raise ValueError("the reply about the table of contents holds no JSON object")
    out = []
    for entry in said.get("chapters") if isinstance(said.get("chapters"), list) else ():
        try:
            out.append((str(entry["title"]), int(entry["start_page"])))
        except (KeyError, TypeError, ValueError):
            continue
    return out


def inferred_toc(samples: DataFrame, provider: Provider) -> DataFrame:
    """(doc, ord, title, start_page) as the provider reads the first pages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, t, p) for d, user in zip(frame["doc"], frame["user"]) for i, (t, p) in enumerate(read_toc(provider.generate(TOC_SYSTEM, user)))]
            yield pd.DataFrame(rows, columns=["doc", "ord", "title", "start_page"])

    asked = samples.select("doc", toc_prompt(F.col("n_pages"), F.col("sample")).alias("user"))
    return asked.mapInPandas(run, f"doc {dict(samples.dtypes)['doc']}, ord int, title string, start_page int")


def chosen_toc(*tocs: DataFrame) -> DataFrame:
    """For each doc the entries of the first table that has any: given by hand, then the outline, then inferred."""
    own = ["doc", "ord", "title", "start_page"]
    out = tocs[0].select(own)
    for other in tocs[1:]:
        out = out.unionByName(other.select(own).join(out.select("doc").distinct(), "doc", "left_anti"))
    return out


def chapters(pages: DataFrame, toc: DataFrame, titles: DataFrame, intervals: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """pages with ord and title of their chapter; a book without entries is one chapter, under the book's own title."""
    bare = pages.join(toc.select("doc").distinct(), "doc", "left_anti").join(titles.select("doc", "title"), "doc", "left")
    return intervals(pages, toc).unionByName(bare.select(pages["*"], F.lit(0).alias("ord"), strip(F.col("title")).alias("title")))
