"""HTML to blocks, and inline markup, over the tree of `foliant.sources.tree`.

Text that stands in no heading, paragraph, list item, quote, code or table falls away. Markup that is kept is written
anew from a short list of tags; nothing of the source's own tags or attributes is passed on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from html import escape, unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foliant.functions import styles as S
from foliant.sources.tree import Node, parse

SCHEMA = (
    "block_index int, type string, level int, text string, items array<string>, ordered boolean, rows array<array<string>>, language string, image_id string, caption string, "
    "rich string, items_rich array<string>, align string, anchor_id string, marker_type string, marker_color string"
)
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
# Content that is dropped whole, links that may stay, captions that say nothing, and what a wrapper of a
# single element passes its alignment or anchor on to.
DROPPED = {"script", "style", "head", "title", "iframe", "object", "embed"}
EXTERNAL = ("http://", "https://", "mailto:")
IN_BOOK = re.compile(r"bbref:[A-Za-z][A-Za-z0-9_-]*")
EMPTY_CAPTIONS = {"image", "img", "figure", "photo", "picture"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
ALIGNED = {*HEADINGS, "p", "blockquote", "img", "figure"}
ANCHORED = {*HEADINGS, "p", "blockquote", "ul", "ol"}
SPACE = re.compile(r"\s+")


def external_only(href: str) -> str | None:
    return href


def own_name(image: Node) -> str | None:
    """A page's image goes by the last part of its address."""
    return image.attrs.get("src", "").rsplit("/", 1)[-1] or None


@dataclass
class Book:
    """What a page takes from the book around it; by default there is none."""

    rules: dict[str, S.Styles] = field(default_factory=dict)
    link: Callable[[str], str | None] = external_only
    image: Callable[[Node], str | None] = own_name
    inline_image: Callable[[Node], str | None] | None = None
    anchor: Callable[[Node], str | None] = lambda node: None
    #: The anchor of a page that names no place itself; its first text takes it.
    spare: str | None = None


def safe_link(href: str) -> str | None:
    return href if href.lower().startswith(EXTERNAL) or IN_BOOK.fullmatch(href) else None


def _styled(inner: str, style: S.Styles) -> str:
    for signal, tag in (("strike", "s"), ("italic", "em"), ("bold", "strong")):
        if inner and signal in style:
            inner = f"<{tag}>{inner}</{tag}>"
    return f'<span style="color:{escape(style["color"])}">{inner}</span>' if inner and "color" in style else inner


def _kept_id(image: Node) -> str | None:
    return image.attrs.get("data-image-id") or None


def _inline(node: Node | str, book: Book) -> str:
    if isinstance(node, str):
        return escape(SPACE.sub(" ", node))
    if node.tag in DROPPED:
        return ""
    if node.tag == "br":
        return "<br/>"
    if node.tag == "img":
        name = (book.inline_image or _kept_id)(node)
        return f'<img data-image-id="{escape(name)}"/>' if name else ""
    inner = "".join(_inline(c, book) for c in node.children)
    if inner and node.tag in ("sup", "sub", "code"):
        inner = f"<{node.tag}>{inner}</{node.tag}>"
    inner = _styled(inner, S.effective(node, book.rules))
    if inner and node.tag == "a" and "href" in node.attrs:
        target = book.link(node.attrs["href"])
        if target and safe_link(target):
            inner = f'<a href="{escape(target)}">{inner}</a>'
    return inner


def rich_of(node: Node, book: Book, own_style: bool = True) -> str:
    """Kept markup of an element's content, within the styles of the element itself."""
    inner = SPACE.sub(" ", "".join(_inline(c, book) for c in node.children)).strip()
    return _styled(inner, S.effective(node, book.rules)) if own_style else inner


def clean(raw: str | None, book: Book | None = None) -> str | None:
    """Allowed inline markup only, well formed; links keep safe targets, others leave their text."""
    return None if raw is None else rich_of(parse(raw), book or Book(), own_style=False)


def shown(rich: str | None) -> str | None:
    """Text of kept markup: breaks become spaces, white space collapses."""
    if rich is None:
        return None
    return SPACE.sub(" ", unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br ?/?>", " ", rich)))).strip()


def plain(markup: str) -> str:
    """Text of markup outside the engine's columns: no tags, entities resolved."""
    return unescape(re.sub(r"<[^>]*>", "", markup))


@dataclass
class _Place:
    align: str | None = None
    anchor: str | None = None


class Walk:
    """Blocks of one page, in order."""

    def __init__(self, book: Book | None = None):
        self.book = replace(book) if book else Book()
        self.out: list[dict] = []

    def page(self, markup: str) -> list[dict]:
        root = parse(markup)
        self.inside(root.first("body") or root, _Place())
        return self.out

    def inside(self, node: Node, place: _Place) -> None:
        for child in node.elements():
            known = self.KINDS.get(child.tag)
            if known:
                known(self, child, place)
            elif child.tag not in DROPPED:
                self.wrapper(child)

    def align(self, node: Node) -> str | None:
        return S.effective(node, self.book.rules).get("align")

    def anchor(self, node: Node, place: _Place) -> str | None:
        found = self.book.anchor(node) or place.anchor
        if found is None and self.book.spare and not any(b["type"] in ("heading", "paragraph", "quote", "list") for b in self.out):
            found, self.book.spare = self.book.spare, None
        return found

    def wording(self, node: Node) -> dict | None:
        """text and rich of an element; null without text."""
        rich = rich_of(node, self.book)
        text = shown(rich) if "<" in rich else node.words()
        return {"text": text, "rich": rich if "<" in rich else None} if text else None

    def prose(self, node: Node, place: _Place, **kind) -> bool:
        said = self.wording(node)
        if said:
            self.out.append(kind | said | {"align": self.align(node) or place.align, "anchor_id": self.anchor(node, place)})
        return said is not None

    def heading(self, node: Node, place: _Place) -> None:
        self.prose(node, place, type="heading", level=HEADINGS[node.tag])

    def paragraph(self, node: Node, place: _Place) -> None:
        if not self.prose(node, place, type="paragraph"):
            self.images(node, place)

    def quote(self, node: Node, place: _Place) -> None:
        self.prose(node, place, type="quote")

    def code(self, node: Node, place: _Place) -> None:
        inner = node.first("code") or node
        named = next((c.split("-", 1)[1] for c in inner.classes if c.startswith(("language-", "lang-"))), None)
        self.out.append({"type": "code", "text": inner.text(), "language": named})

    def list_(self, node: Node, place: _Place) -> None:
        items = [said for li in node.elements() if li.tag == "li" and (said := self.wording(li))]
        if not items:
            return
        style = S.effective(node, self.book.rules)
        rich = [i["rich"] or i["text"] for i in items] if any(i["rich"] for i in items) else None
        own = {"items": [i["text"] for i in items], "items_rich": rich, "ordered": node.tag == "ol", "marker_type": style.get("marker"), "marker_color": style.get("color")}
        self.out.append({"type": "list", **own, "anchor_id": self.anchor(node, place)})

    def table(self, node: Node, place: _Place) -> None:
        rows = [[c.words() for c in tr.find("th", "td")] for tr in node.find("tr")]
        self.out.append({"type": "table", "rows": [r for r in rows if r]})

    def images(self, node: Node, place: _Place) -> None:
        """All images of an element, under its caption if it has one."""
        said = node.first("figcaption")
        within = _Place(self.align(node) or place.align)
        for image in node.find("img"):
            self.image(image, within, said.words() if said else None)

    def image(self, node: Node, place: _Place, caption: str | None = None) -> None:
        if not node.attrs.get("src") or not (name := self.book.image(node)):
            return
        caption = caption or node.attrs.get("alt")
        if caption is not None and caption.strip().lower() in EMPTY_CAPTIONS:
            caption = None
        align = self.align(node) or place.align or next((a for a in map(self.align, node.ancestors()) if a), None)
        self.out.append({"type": "image", "image_id": name, "caption": caption or None, "align": align})

    def wrapper(self, node: Node) -> None:
        """Any other element: with just one element in it, that takes its alignment and anchor."""
        kids, place = node.elements(), _Place()
        if len(kids) == 1:
            align, anchor = self.align(node), self.book.anchor(node)
            if (align and kids[0].tag in ALIGNED) or (anchor and kids[0].tag in ANCHORED):
                place = _Place(align, anchor)
        self.inside(node, place)

    KINDS = dict.fromkeys(HEADINGS, heading) | {"p": paragraph, "blockquote": quote, "pre": code, "ul": list_, "ol": list_, "table": table, "figure": images, "img": image}


def walk(markup: str, book: Book | None = None) -> list[dict]:
    return Walk(book).page(markup)


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row per block of each page, in order; null markup has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *(b.get(n) for n in NAMES[1:])) for k, h in zip(batch[key], batch[html]) for i, b in enumerate(walk(h or ""))]
            frame = pd.DataFrame(rows, columns=[key, *NAMES])
            yield frame.astype({"level": "Int32", "ordered": "boolean"})

    return pages.select(key, html).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, {SCHEMA}")


def sanitize(column: str | Column) -> Column:
    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(clean, na_action="ignore")

    return run(column)


def _unescaped(c: Column) -> Column:
    for entity, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(raw))
    return c


def strip_tags(column: str | Column) -> Column:
    """Text of sanitized markup: breaks become spaces, white space collapses."""
    c = F.col(column) if isinstance(column, str) else column
    text = _unescaped(F.regexp_replace(F.regexp_replace(c, r"<br/?>", " "), r"<[^>]*>", ""))
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def text_as_markup(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def has_markup(c: Column) -> Column:
    return F.contains(c, F.lit("<"))


_TAG = r'<([a-z]+)(?: (?:href|style|data-image-id)="([^"]*)")?/?>'


def tag_signature(c: Column) -> Column:
    """The multiset of sanitized markup's tags, sorted; links, colours and images count with their target."""
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(_TAG), 1).alias("t"), F.regexp_extract_all(c, F.lit(_TAG), 2).alias("v"))
    named = F.transform(pairs, lambda x: F.when(x["t"].isin("a", "span", "img"), F.concat(x["t"], F.lit(":"), _unescaped(x["v"]))).otherwise(x["t"]))
    return F.array_sort(named)


def inline_image_ids(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r'<img data-image-id="([^"]+)"/>'), 1), _unescaped)


def block_image_ids() -> Column:
    """All images that a block (type, image_id, rich, items_rich) shows, its own or inside its text."""
    inside = F.when(F.col("type") == "list", F.flatten(F.transform(F.coalesce("items_rich", F.array().cast("array<string>")), inline_image_ids))).otherwise(
        F.coalesce(inline_image_ids(F.col("rich")), F.array().cast("array<string>"))
    )
    return F.when(F.col("type") == "image", F.array("image_id")).otherwise(inside)
