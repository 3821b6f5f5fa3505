"""Archives, replies, translation and providers."""

import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.functions import prompts as P, provider as V
from foliant.operators import replies as R, translate as X
from foliant.sources import epub as E


@pytest.mark.parametrize(("base", "href", "path"), [("OEBPS/text/a.xhtml", "../img/b%20c.png#x", "OEBPS/img/b c.png"), ("a.xhtml", "b.xhtml?q", "b.xhtml")])
def test_paths_inside(base, href, path):
    assert E.inside(base, href) == path


@pytest.mark.parametrize("href", ["../../x", "/etc/x", "../.."])
def test_paths_outside(href):
    with pytest.raises(ValueError, match="leaves"):
        E.inside("OEBPS/a.xhtml", href)


def test_book_round_trip(tmp_path):
    made = E.make_book("A & B", [("One", "<h1>One</h1><p>x &lt; y</p>"), (None, "<ul><li>a</li></ul>")], author="me", language="fr", images=[("i.png", "image/png", b"1"), ("i.png", "image/png", b"2")], cover="i.png")
    assert made == E.make_book("A & B", [("One", "<h1>One</h1><p>x &lt; y</p>"), (None, "<ul><li>a</li></ul>")], author="me", language="fr", images=[("i.png", "image/png", b"1"), ("i.png", "image/png", b"2")], cover="i.png")
    (tmp_path / "b.EPUB").write_bytes(made)
    with zipfile.ZipFile(tmp_path / "b.EPUB") as z:
        assert z.namelist()[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED
        assert {"OEBPS/images/i.png", "OEBPS/images/i-2.png"} <= set(z.namelist())
    book = E.Book(made)
    assert (book.title, book.author, book.language, book.items[book.cover][0]) == ("A & B", "me", "fr", "OEBPS/images/i.png")
    got = [(r[0], r[1], r[3], r[5]) for r in E.chapter_rows(made)]
    assert got[1:] == [(1, "One", "heading", "One"), (1, "One", "paragraph", "x < y"), (2, "A & B", "list", None)] and got[0][2] == "image"


def test_scan_and_cover(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(E.make_book("T", [("One", "<p>x</p>")], images=[("c.png", "image/png", b"1")], cover="c.png"))
    (tmp_path / "n.txt").write_text("no")
    books = E.scan(spark, str(tmp_path))
    assert E.read_metadata(books, "path").select("title", "cover", "chapters").collect() == [("T", "img-c.png", 2)]
    blocks = E.read_blocks(books, "path")
    left = E.without_leading_cover(blocks, books.select("path", F.lit("img-c.png").alias("cover")), "path")
    assert [r["type"] for r in left.collect()] == ["paragraph"]


def test_not_a_book():
    with pytest.raises(ValueError, match="not an EPUB"):
        E.Book(b"x")


def test_only_the_first_of_a_split_keeps_its_anchor():
    got = R.read_reply(["paragraph", "list"], [{"block": 1, "text": "a"}, {"block": 1, "text": "b"}, {"block": 2, "type": "list", "items": ["x", " ", 3]}])
    assert [(p["source"], p["anchored"], p["items"]) for p in got] == [(1, True, None), (1, False, None), (2, True, ["x", "3"])]


def test_bisection_isolates_bad_units():
    asked = []

    def provider(batch):
        asked.append(len(batch))
        return "torn" if "bad" in batch.values() else '{"translations": {%s}}' % ", ".join(f'"{i}": "t{i}", "99": "x"' for i in batch)

    assert X.ask({str(i): "bad" if i == 5 else "ok" for i in range(8)}, provider) == {str(i): f"t{i}" for i in range(8) if i != 5}
    assert asked == [8, 8, 4, 4, 4, 2, 2, 1, 1, 1, 2]


def test_keys_rotate():
    slept, used = [], []

    def call(key):
        used.append(key)
        if key == "a":
            raise V.Refused
        if len(used) < 4:
            raise V.Limited
        return "ok"

    assert V.patiently(call, ["a", "b", "c"], sleep=slept.append) == "ok"
    assert used == ["a", "b", "c", "a", "b"] and slept == [0.5, 1.0]
    with pytest.raises(V.Refused):
        V.patiently(lambda k: (_ for _ in ()).throw(V.Refused()), ["a"], sleep=slept.append)


@pytest.mark.parametrize(("url", "keys", "fine"), [("http://localhost:1/v1", True, True), ("https://10.0.0.3/v1", True, True), ("https://host/v1", True, False), ("https://host/v1", False, True), ("file:///x", False, False), ("https://known/v1", True, True)])
def test_endpoints(url, keys, fine):
    if fine:
        V.check_endpoint(url, {"known"}, keys)
    else:
        with pytest.raises(ValueError):
            V.check_endpoint(url, {"known"}, keys)


def test_manual_toc(spark, tmp_path):
    (tmp_path / "toc.json").write_text('[{"title": "A", "start_page": 3}, {"title": "B", "start_page": 9}]')
    assert P.manual_toc(spark, str(tmp_path / "toc.json")).collect() == [("A", 3, 0), ("B", 9, 1)]
    (tmp_path / "bad.json").write_text('[{"title": "A"}]')
    with pytest.raises(Exception, match="start_page"):
        P.manual_toc(spark, str(tmp_path / "bad.json")).collect()


def test_services():
    made = V.service("Gemini", "m", {"GEMINI_API_KEY": "a, b"})
    assert made.keys == ["a", "b"] and made.options == {"reasoning_effort": "disable"}
    assert V.service("gemini", "m", {"GEMINI_API_KEY": "a"}, thinking="auto").options == {}
    assert V.service("openai", "m", {"OPENAI_API_KEY": "a"}, thinking="low").options == {"reasoning_effort": "low"}
    assert V.service("ollama", "m", {}).keys == []
    assert V.service("openai", "m", {}, url="http://127.0.0.1:9/v1").keys == []
    for bad in (("none", {}), ("openai", {}), ("gemini", {"GEMINI_API_KEY": " , "})):
        with pytest.raises(ValueError):
            V.service(bad[0], "m", bad[1])
    with pytest.raises(ValueError, match="unlisted"):
        V.service("openai", "m", {"OPENAI_API_KEY": "a"}, url="https://elsewhere/v1")


@pytest.mark.parametrize(("path", "name"), [("a/b c.png", "b_c.png"), ("a/..x", "x.png"), ("noend", "noend.png"), (None, "id_1.png"), ("a/", "id_1.png"), ("a/..", "image.png")])
def test_image_names(spark, path, name):
    from foliant.functions import text as T

    assert spark.range(1).select(T.image_filename(F.lit(path).cast("string"), F.lit("id 1"), F.lit(".png")).alias("n")).first()["n"] == name
