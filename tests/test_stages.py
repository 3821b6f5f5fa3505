"""The provider stages and whole books."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliant import __main__ as cli, engine
from foliant.functions.provider import ChatProvider, Extracting
from foliant.operators import stages as S, vision as V
from foliant.sources import epub as E, pdf as P

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


def block(kind, run=None, **more):
    return dict.fromkeys(S.FIELDS) | {"type": kind, "run_id": run} | more


CHUNK = [block("heading", level=1, text="H"), block("paragraph", 1, text="one two three four", align="center", anchor_id="a1"), block("list", 1, items=["a b", "c"], ordered=True), block("image", image_id="i"), block("paragraph", 2, text="five six", rich="<em>five</em> six")]


class Says:
    """Answers in turn."""

    def __init__(self, *replies):
        self.replies, self.asked = list(replies), 0

    def generate(self, system, user):
        self.asked += 1
        return self.replies.pop(0)


GOOD = json.dumps({"texts": {"1": [{"block": 1, "text": "one"}, {"block": 2, "type": "list", "items": ["a"]}], "2": "five"}, "essential_images": ["i"]})


def test_answer_is_put_in_place():
    got = S.ask(Says(GOOD), "", "", CHUNK, True)
    assert got["answered"] and got["kept"] == ["i"] and got["degraded"] == 0
    assert [(b["type"], b["text"], b["items"], b["align"], b["anchor_id"], b["ordered"], b["rich"]) for b in got["blocks"][1:3]] == [("paragraph", "one", None, "center", "a1", None, None), ("list", None, ["a"], None, None, True, None)]
    assert got["blocks"][4]["text"] == "five"


def test_images_not_named_go():
    got = S.ask(Says(json.dumps({"texts": {"1": ["x", {"type": "list", "items": ["y"]}], "2": "z"}})), "", "", CHUNK, True)
    assert got["dropped"] == ["i"] and [b["type"] for b in got["blocks"]] == ["heading", "paragraph", "list", "paragraph"]
    assert S.ask(Says(GOOD.replace('["i"]', "[]")), "", "", CHUNK, False)["kept"] == ["i"]


def test_one_bad_run_is_kept_and_all_bad_are_asked_again():
    part = json.dumps({"texts": {"1": "no list in it", "2": "z"}, "essential_images": []})
    one = Says(part)
    got = S.ask(one, "", "", CHUNK, True)
    assert one.asked == 1 and got["degraded"] == 1 and got["blocks"][1]["text"] == "one two three four" and got["blocks"][-1]["text"] == "z"
    bad = Says("torn", '{"texts": {}}', GOOD)
    assert S.ask(bad, "", "", CHUNK, True)["answered"] and bad.asked == 3


def test_exhausted_keeps_everything():
    got = S.ask(Says("x", "{", "[]"), "", "", CHUNK, True)
    assert not got["answered"] and got["kept"] == ["i"] and [b["text"] for b in got["blocks"]] == [b["text"] for b in CHUNK]


def test_without_prose_nobody_is_asked():
    silent = Says()
    got = S.ask(silent, "", "", [CHUNK[0], CHUNK[3]], True)
    assert got["answered"] and got["kept"] == ["i"] and silent.asked == 0


def chapters(spark, words, chunks=2, extra=()):
    rows = [(1, c, 100 * chunks, 0, ["i"], [], [(*(None if f not in ("type", "text") else "paragraph" if f == "type" else " ".join(["word"] * words) for f in S.FIELDS),)]) for c in range(1, chunks + 1)]
    done = spark.createDataFrame(rows, f"chapter int, chunk_no int, input_tokens long, degraded int, kept array<string>, dropped array<string>, blocks {S.BLOCKS}")
    return S.chapters_of(done, ["chapter"])


class Shrinks:
    """Keeps a share of the words for smoothing and one for trimming; null fails."""

    def __init__(self, smooth, trim):
        self.smooth, self.trim = smooth, trim

    def generate(self, system, user):
        share = self.trim if user.startswith("Shorten further") else self.smooth
        said = json.loads(Extracting().generate(system, user.replace("about", "about 100% of its length,", 1)))
        if share is None:
            return "torn"
        for run in said["texts"].values():
            for entry in run:
                entry["text"] = " ".join((entry["text"].split() * 3)[: max(1, round(share * len(entry["text"].split())))])
        return json.dumps(said)


@pytest.mark.parametrize(
    ("smooth", "trim", "passes", "tokens", "failed"),
    [(0.1, 0.5, 0, 100, False), (0.8, 0.5, 1, 400, False), (0.8, 1.0, 1, 800, False), (0.8, None, 0, 800, False), (None, 0.5, 0, 1000, True)],
)
def test_smoothing_and_trimming(spark, smooth, trim, passes, tokens, failed):
    row = S.synthesize(chapters(spark, 400), ["chapter"], Shrinks(smooth, trim), ratio=0.3).first()
    assert (row["trim_passes"], row["failed"], row["smoothed"], row["target_tokens"], row["kept"]) == (passes, failed, True, 120, ["i", "i"])
    assert abs(row["output_tokens"] - tokens) <= 4


def test_a_small_chapter_is_not_asked_about(spark):
    row = S.synthesize(chapters(spark, 20, 1), ["chapter"], Says(), ratio=0.3).first()
    assert not row["smoothed"] and not row["failed"] and row["output_tokens"] == 24


def test_verdicts():
    assert V.read_verdict('x {"score": "0.7", "caption": " "} y') == (0.7, None, True)
    assert V.read_verdict('{"score": "high", "essential": true, "caption": "c"}') == (0.0, "c", True)
    assert V.read_verdict("torn {") == (1.0, None, False) and V.read_verdict("[1]") == (1.0, None, False)
    score = V.read_verdict('{"score": "nan"}')[0]
    assert not score >= V.THRESHOLD


def test_toc_reply():
    assert P.read_toc('```{"chapters": [{"title": 1, "start_page": "2"}, {"title": "x"}, 3, {"title": "y", "start_page": "z"}]}```') == [("1", 2)]
    assert P.read_toc('{"chapters": 3}') == []
    with pytest.raises(ValueError):
        P.read_toc("none")


def extract(data):
    line = lambda top, text, font="Times", size=10.0: (top, top + 12, text, [(font, size)] * len(text))
    made = P.Extracted(title="Book" if data == b"1" else None, outline=[("One", 0), ("Two", 1)] if data == b"1" else [])
    made.lines = [[line(0, "Title", size=18.0), line(20, "a"), line(32, "b"), line(60, "c"), line(80, "x = 1", "Courier New"), line(100, "in table")], [line(0, "second", "Times-Bold", 10.6), line(14, "d")]]
    made.tables = [[(98.0, 115.0, [["in", " table "], [None, ""]])], []]
    made.images = [[("p.jpg", b"same")], [("q.png", b"same"), ("r.gif", b"other")]]
    return made


def test_pdf_books(spark):
    files = spark.createDataFrame([("d/one.pdf", bytearray(b"1")), ("d/two.pdf", bytearray(b"2"))], "path string, content binary")
    books = engine.read_pdf(files, extract)
    got = [tuple(r) for r in books.blocks.where("doc = 'd/one.pdf'").orderBy("chapter", "block_index").select("chapter", "block_index", "type", "level", F.coalesce("text", "image_id"), "rows").collect()]
    same = "pdfimg-" + __import__("hashlib").sha256(b"same").hexdigest()[:16]
    other = "pdfimg-" + __import__("hashlib").sha256(b"other").hexdigest()[:16]
    assert got == [
        (0, 0, "heading", 1, "Title", None), (0, 1, "paragraph", None, "a b", None), (0, 2, "paragraph", None, "c", None), (0, 3, "code", None, "x = 1", None),
        (0, 4, "table", None, None, [["in", "table"]]), (0, 5, "image", None, same, None), (1, 0, "heading", 2, "second", None), (1, 1, "paragraph", None, "d", None), (1, 2, "image", None, other, None),
    ]
    assert sorted((r.doc, r.chapter, r.title) for r in books.titles.collect()) == [("d/one.pdf", 0, "One"), ("d/one.pdf", 1, "Two"), ("d/two.pdf", 0, "two")]
    assert {(r.image_id, r.mime) for r in books.images.collect()} == {(same, "image/jpeg"), (other, "image/gif")}
    assert books.blocks.where("doc = 'd/two.pdf'").count() == 9


def test_unsupported_input():
    assert engine.suffix("a/B.EPUB") == ".epub"
    with pytest.raises(ValueError, match="unsupported"):
        engine.suffix("a.txt")


@pytest.fixture
def shelf(tmp_path):
    words = " ".join(f"word{i}" for i in range(400))
    body = f'<h1 id="t">One</h1><p>{words}</p><ul><li>{words}</li><li>last</li></ul><p>see <a href="chap-2.xhtml">two</a></p><img src="images/f.png" alt="Fig"/>'
    data = E.make_book("My Book", [("One", body), ("Two", f"<h2>Two</h2><p><b>bold</b> {words}</p>")], author="me", images=[("f.png", "image/png", b"1"), ("c.png", "image/png", b"2")], cover="c.png")
    (tmp_path / "b.epub").write_bytes(data)
    return tmp_path


def test_condense_write_and_resume(spark, shelf):
    books = engine.read(spark, f"{shelf}/b.epub")
    assert engine.estimate(books).first()["chapters"] == 3
    log = f"{shelf}/log"
    first = engine.condense(spark, books, Extracting(), ratio=0.3, chunk_tokens=500, log_path=log)
    report = first.report.first()
    assert 0 < report["output_tokens"] < 0.45 * report["input_tokens"]
    made, skipped = engine.write(engine.chosen(first.books), f"{shelf}/out", ["md", "epub", "pdf"])
    assert set(made) == {"md", "epub"} and skipped[0].startswith("pdf: skipped")
    text = (shelf / "out/b.md").read_text()
    assert text.startswith("# My Book\n\n") and "\n\n# One\n\n" in text and "![Fig](images/f.png)" in text and text.endswith("\n")
    again = engine.read(spark, f"{shelf}/out/b.epub")
    assert again.about.first()["cover"] is not None and [r.title for r in again.titles.orderBy("chapter").collect()] == ["Cover", "One", "Two"]
    # A second, resumed run asks nobody; one that isn't resumed has nothing to reuse.
    second = engine.condense(spark, books, Says(), ratio=0.3, chunk_tokens=500, log_path=log, resume=True)
    assert all(r.total == r.reused > 0 for r in S.reuse_counters(second.phases).collect())
    third = engine.condense(spark, books, Extracting(), ratio=0.3, chunk_tokens=500, log_path=log)
    assert all(r.reused == 0 for r in S.reuse_counters(third.phases).collect())


def test_failed_chunks_are_told_and_not_stored(spark, shelf):
    class Mute:
        def generate(self, system, user):
            return "nothing"

    books = engine.read(spark, f"{shelf}/b.epub")
    got = engine.condense(spark, books, Mute(), chunk_tokens=500, log_path=f"{shelf}/log2")
    said = [r.warning for r in got.warned().collect()]
    assert any("could not be condensed" in w for w in said) and got.phases["condense"].where("failed").count() > 0
    assert got.books.blocks.where("type = 'paragraph'").count() == books.blocks.where("type = 'paragraph'").count()
    again = engine.condense(spark, books, Extracting(), chunk_tokens=500, log_path=f"{shelf}/log2", resume=True)
    assert again.phases["condense"].where("failed").count() == 0


class Upper:
    """A translator that says all in capitals, loses bold, and can't say anything about units with a zero."""

    def generate(self, system, user):
        import re

        units = re.findall(r"(?m)^\[(\d+)\] (.*)$", user)
        if any("word0 " in t for _, t in units):
            return "torn"
        return json.dumps({"translations": {i: t.upper().replace("<STRONG>", "").replace("</STRONG>", "") for i, t in units}})


def test_translate(spark, shelf):
    books = engine.read(spark, f"{shelf}/b.epub")
    got = engine.translate(books, Upper(), "Spanish")
    assert got.books.about.first()["language"] == "es"
    assert [r.title for r in got.books.titles.orderBy("chapter").collect()] == ["COVER", "ONE", "TWO"]
    lists = got.books.blocks.where("type = 'list'").first()
    assert lists["items"][1] == "LAST" and lists["items"][0].startswith("word0 ")
    assert "segments stay untranslated" in got.warned().first()["warning"]


def test_command_line(spark, shelf, capsys):
    with pytest.raises(SystemExit):
        cli.main(["translate", "x"])
    assert cli.main(["version"]) == 0
    assert cli.main(["condense", f"{shelf}/b.epub", "--dry-run"], spark) == 0
    assert '"chapters":3' in capsys.readouterr().out
    assert cli.main(["condense", f"{shelf}/b.epub", "--out", f"{shelf}/cli", "--formats", "md"], spark) == 0
    assert (shelf / "cli/b.md").exists()


def test_chat_provider():
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers.get("Authorization"), body["messages"][1]["content"]))
            code = 401 if len(seen) == 1 else 200
            data = json.dumps({"choices": [{"message": {"content": "hi"}}]}).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        provider = ChatProvider(f"http://127.0.0.1:{server.server_port}/v1", "m", "k1, k2")
        assert provider.generate("s", "u") == "hi"
        assert seen == [("Bearer k1", "u"), ("Bearer k2", "u")]
    finally:
        server.shutdown()
