"""EPUB archives as rows: books are bytes in a column, so that scans and writes are row-local and run where the bytes are.

Reading walks container, package and spine; spine entries that lead nowhere, aren't (X)HTML or leave the archive are
skipped. Writing is deterministic: equal books give equal bytes.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import itertools
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html import escape
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.functions import styles as S
from foliant.sources import html as H
from foliant.sources.tree import Node, parse

CONTAINER = "META-INF/container.xml"
STAMP = (1980, 1, 1, 0, 0, 0)
MODIFIED = "2000-01-01T00:00:00Z"
CHAPTERS = "chapter int, chapter_title string, " + H.SCHEMA
IMAGES = "path string, image_id string, mime string, alt string, sha256 string, content binary"


def inside(base: str, href: str) -> str:
    """Path in the archive of a reference from the file base; ValueError if it leaves the archive."""
    target = unquote(re.split("[#?]", href, maxsplit=1)[0])
    at = base.split("/")[:-1]
    for part in target.split("/"):
        if part == ".." and not at or target.startswith("/"):
            raise ValueError(f"reference leaves the archive: {href!r}")
        if part == "..":
            at.pop()
        elif part not in ("", "."):
            at.append(part)
    if not at and ".." in target:
        raise ValueError(f"reference leaves the archive: {href!r}")
    return "/".join(at)


def _elements(xml: bytes) -> Iterator[tuple[str, ElementTree.Element]]:
    for e in ElementTree.fromstring(xml).iter():
        if isinstance(e.tag, str):  # comments have no name
            yield e.tag.rsplit("}", 1)[-1], e


def named_place(node: Node) -> str | None:
    """The name by which a link can point at an element: its id, or the name of an anchor."""
    own = node.attrs.get("id", "").strip()
    return own or (node.attrs.get("name", "").strip() if node.tag == "a" else "") or None


class Anchors:
    """Names a1, a2, ... of the places that links within a book can point at, in the order of the spine."""

    def __init__(self, pages: list[tuple[str, str]]):
        self.places: dict[tuple[str, str], str] = {}
        self.pages: dict[str, str] = {}
        self.spare: dict[str, str] = {}
        count = itertools.count(1)
        for path, markup in pages:
            root = parse(markup)
            heading = first = None
            for node in (root.first("body") or root).descendants():
                place = (path, named_place(node))
                if place[1] is None or place in self.places:
                    continue
                name = self.places[place] = f"a{next(count)}"
                first = first or name
                if node.tag in H.HEADINGS:
                    heading = heading or name
            if not first:  # nothing here has a name, but a link may point at the file
                first = self.spare[path] = f"a{next(count)}"
            self.pages[path] = heading or first

    def resolver(self, page: str):
        """Targets of links on a page: external ones stay, those to a known place become bbref:, others have none."""

        def target(href: str) -> str | None:
            if href.lower().startswith(H.EXTERNAL):
                return href
            file, _, place = href.partition("#")
            place = unquote(place.split("?", 1)[0]).strip()
            try:
                path = inside(page, file) if file else page
            except ValueError:
                return None
            if not place and not file:
                return None
            name = self.places.get((path, place)) if place else self.pages.get(path)
            return f"bbref:{name}" if name else None

        return target


class Book:
    """An archive with its package read; pages, sheets and images are read when asked for."""

    def __init__(self, data: bytes):
        try:
            self.archive = zipfile.ZipFile(io.BytesIO(data))
            package = next(e.get("full-path") for name, e in _elements(self.archive.read(CONTAINER)) if name == "rootfile" and e.get("full-path"))
            elements = list(_elements(self.archive.read(package)))
        except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
            raise ValueError("not an EPUB: no archive, container or package") from e
        self.title, self.author, self.language = "Untitled", None, None
        self.items: dict[str, tuple[str, str]] = {}
        self.spine: list[str] = []
        cover = None
        for name, e in elements:
            said = (e.text or "").strip()
            if name in ("title", "creator", "language") and said:
                setattr(self, "author" if name == "creator" else name, said)
            elif name == "item" and e.get("id") and e.get("href"):
                with contextlib.suppress(ValueError):
                    self.items[e.get("id")] = (inside(package, e.get("href")), e.get("media-type") or "")
            elif name == "itemref" and e.get("idref"):
                self.spine.append(e.get("idref"))
            elif name == "meta" and e.get("name") == "cover" and (e.get("content") or "").strip():
                cover = e.get("content").strip()
        self.by_path: dict[str, tuple[str, str]] = {}
        for key, (path, mime) in self.items.items():
            self.by_path.setdefault(path, (key, mime))
        self.cover = cover if cover in self.items and self.holds(self.items[cover][0]) else None
        self.images: dict[str, tuple[str, str, str | None]] = {}

    def holds(self, path: str) -> bool:
        return path in self.archive.NameToInfo

    def pages(self) -> list[tuple[str, str]]:
        """(path, markup) of the spine's pages; entries that lead nowhere or aren't (X)HTML are skipped."""
        held = (self.items.get(key, ("", "")) for key in self.spine)
        return [(path, self.archive.read(path).decode("utf-8", "replace")) for path, mime in held if "html" in mime.lower() and self.holds(path)]

    def rules(self) -> dict[str, S.Styles]:
        sheets = [path for path, mime in self.items.values() if "css" in mime.lower() and self.holds(path)]
        return S.merged([self.archive.read(path).decode("utf-8", "ignore") for path in sheets])

    def image(self, path: str, alt: str | None) -> str | None:
        """The id of an image in the archive, noted down with what was first said of it; null if it isn't there."""
        key, mime = self.by_path.get(path, (path.rsplit("/", 1)[-1], ""))
        if key not in self.images:
            if not self.holds(path):
                return None
            self.images[key] = (path, mime or "application/octet-stream", alt)
        return key

    def chapters(self) -> Iterator[tuple[int, str | None, list[dict]]]:
        """(number, title, blocks): a chapter is titled by its first heading, else by its page title."""
        pages = self.pages()
        anchors, rules = Anchors(pages), self.rules()
        for n, (path, markup) in enumerate(pages):

            def block_image(node: Node, path=path) -> str | None:
                return self.image(inside(path, node.attrs["src"]), node.attrs.get("alt"))

            def inline_image(node: Node, path=path) -> str | None:
                try:
                    return block_image(node, path) if node.attrs.get("src") else None
                except ValueError:  # inside a text it's left out; as a block of its own it fails the book
                    return None

            def anchor(node: Node, path=path) -> str | None:
                return anchors.places.get((path, named_place(node) or ""))

            around = H.Book(rules, anchors.resolver(path), block_image, inline_image, anchor, anchors.spare.get(path))
            blocks = H.walk(markup, around)
            own = re.search(r"(?is)<title[^>]*>(.*?)</title>", markup)
            yield n, next((b["text"] for b in blocks if b["type"] == "heading"), own and H.plain(own[1]).strip() or None), blocks

    def image_rows(self) -> Iterator[tuple]:
        """Rows of IMAGES: those that blocks show, in the order met, and the cover."""
        for _ in self.chapters():
            pass
        if self.cover:
            self.image(self.items[self.cover][0], None)
        for key, (path, mime, alt) in self.images.items():
            data = self.archive.read(path)
            yield path, key, mime, alt, hashlib.sha256(data).hexdigest(), data


def chapter_rows(data: bytes) -> Iterator[tuple]:
    """Rows of CHAPTERS."""
    for n, title, blocks in Book(data).chapters():
        for i, b in enumerate(blocks):
            yield (n, title, i, *(b.get(name) for name in H.NAMES[1:]))


def _read(books: DataFrame, key: str, data: str, schema: str, rows, ints: dict[str, str]) -> DataFrame:
    names = [key, *(f.split()[0] for f in schema.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(k, *r) for k, held in zip(frame[key], frame[data]) if held is not None for r in rows(held)]
            yield pd.DataFrame(found, columns=names).astype(ints)

    return books.select(key, data).mapInPandas(run, f"{key} {dict(books.dtypes)[key]}, {schema}")


def read_blocks(books: DataFrame, key: str, data: str = "content") -> DataFrame:
    """key, chapter, chapter_title and the columns of a walk, for books as bytes. What isn't an EPUB fails the query."""
    return _read(books, key, data, CHAPTERS, chapter_rows, {"level": "Int32", "ordered": "boolean"})


def read_images(books: DataFrame, key: str, data: str = "content") -> DataFrame:
    """key and the columns of IMAGES: what a book shows, with its bytes."""
    return _read(books, key, data, IMAGES, lambda held: Book(held).image_rows(), {})


def _metadata(data: bytes) -> Iterator[tuple]:
    book = Book(data)
    yield book.title, book.author, book.language, book.cover, len(book.pages())


def read_metadata(books: DataFrame, key: str, data: str = "content") -> DataFrame:
    """key, title, author, language, cover (an image id) and number of chapters."""
    return _read(books, key, data, "title string, author string, language string, cover string, chapters int", _metadata, {})


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the EPUB files of a folder; other suffixes are left out."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][pP][uU][bB]").option("recursiveFileLookup", "true").load(path).select("path", "content")


def unique(names: list[str], whole: bool = False) -> Iterator[str]:
    """Names made distinct by -2, -3 and so on before the extension, or at the end of the whole name."""
    used: set[str] = set()
    for name in names:
        stem, ext = (name, "") if whole else posixpath.splitext(name)
        n, new = 1, name
        while new in used:
            n += 1
            new = f"{stem}-{n}{ext}"
        used.add(new)
        yield new


def xml_ids(names: list[str]) -> list[str]:
    """Distinct names that XML takes as ids: other characters become underscores, and a letter or underscore leads."""
    safe = (re.sub(r"[^A-Za-z0-9._-]", "_", n) or "id" for n in names)
    return list(unique([n if n[0].isalpha() or n[0] == "_" else f"id-{n}" for n in safe], whole=True))


def page(title: str, body: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml">\n<head><title>{escape(title)}</title></head>\n<body>\n{body}\n</body>\n</html>\n'


def make_book(title: str, chapters: list[tuple[str | None, str]], *, author: str | None = None, language: str | None = None, images: list[tuple[str, str, bytes]] = (), cover: str | None = None) -> bytes:
    """Bytes of an EPUB 3 of chapters (title, markup) and images (file name, mime, bytes); cover is one's file name."""
    names = list(unique([n for n, _, _ in images]))
    ids = xml_ids([f"img-{n}" for n in names])
    front = next((n for n, (own, _, _) in zip(names, images) if own == cover), None) if cover else None
    pages = [(f"chap-{i}", f"chap-{i}.xhtml", t or f"Chapter {i}", page(t or title, body)) for i, (t, body) in enumerate(chapters, 1)]
    if front:
        pages.insert(0, ("cover-page", "cover.xhtml", "", page("Cover", f'<img src="images/{escape(front)}" alt="Cover"/>')))
    items = ['<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>']
    items += [f'<item id="{i}" href="{href}" media-type="application/xhtml+xml"/>' for i, href, _, _ in pages]
    items += [f'<item id="{i}" href="images/{escape(n)}" media-type="{escape(mime)}"{" properties=" + chr(34) + "cover-image" + chr(34) if n == front else ""}/>' for i, n, (_, mime, _) in zip(ids, names, images)]
    about = [f'<dc:identifier id="bookid">urn:foliant:{hashlib.sha256(title.encode()).hexdigest()[:16]}</dc:identifier>', f"<dc:title>{escape(title)}</dc:title>", f"<dc:language>{escape(language or 'en')}</dc:language>"]
    about += [f"<dc:creator>{escape(author)}</dc:creator>"] if author else []
    about += [f'<meta name="cover" content="{ids[names.index(front)]}"/>'] if front else []
    about.append(f'<meta property="dcterms:modified">{MODIFIED}</meta>')
    package = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="bookid">\n'
        f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{"".join(about)}</metadata>\n<manifest>{"".join(items)}</manifest>\n'
        f'<spine>{"".join(f"<itemref idref={chr(34)}{i}{chr(34)}/>" for i, *_ in pages)}</spine>\n</package>\n'
    )
    links = "".join(f'<li><a href="{href}">{escape(t)}</a></li>' for _, href, t, _ in pages if t)
    nav = page("Contents", f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{links}</ol></nav>')
    container = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'
    files = [("mimetype", b"application/epub+zip"), (CONTAINER, container), ("OEBPS/content.opf", package), ("OEBPS/nav.xhtml", nav)]
    files += [(f"OEBPS/{href}", text) for _, href, _, text in pages] + [(f"OEBPS/images/{n}", data) for n, (_, _, data) in zip(names, images)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name, STAMP), data, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_books(books: DataFrame, key: str) -> DataFrame:
    """key and content (bytes) for books (title, language, chapters: array of (title, html)).

    Where there, author, images (array of (name, mime, data)) and cover (an image's name) are written too.
    """
    some = [c for c in ("author", "images", "cover") if c in books.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for row in frame.to_dict("records"):
                more = {c: row[c] for c in some}
                if more.get("images") is not None:
                    more["images"] = [(i["name"], i["mime"], i["data"]) for i in more["images"]]
                more = {c: v for c, v in more.items() if v is not None}
                made.append(make_book(row["title"], [(c["title"], c["html"]) for c in row["chapters"]], language=row["language"], **more))
            yield pd.DataFrame({key: frame[key], "content": made})

    return books.select(key, "title", "language", "chapters", *some).mapInPandas(run, f"{key} {dict(books.dtypes)[key]}, content binary")


def without_leading_cover(blocks: DataFrame, books: DataFrame, key: str) -> DataFrame:
    """Blocks without a first chapter that is nothing but the book's cover image; books hold (key, cover)."""
    first = blocks.groupBy(key, "chapter").agg(F.count("*").alias("n"), F.max(F.when(F.col("type") == "image", F.col("image_id"))).alias("image_id"))
    only = first.join(books.select(key, "cover"), key).where("chapter = 0 and n = 1 and image_id = cover").select(key, "chapter")
    return blocks.join(only, [key, "chapter"], "left_anti")
