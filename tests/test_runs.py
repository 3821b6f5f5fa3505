"""Runs that are resumed, what their calls took, and the log that they leave."""

import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliant import engine
from foliant.functions.provider import USAGE, Counted
from foliant.operators import anchors as A, reply_columns as RC, translate as X
from foliant.operators.replies import read_reply
from foliant.streaming.log import Folders, Log, last_rows

KEYS = ["k"]
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks don't see the tests


class Upper:
    """Translates by capitals, counts its calls in what they took, and refuses a word."""

    def __init__(self, bad="none"):
        self.bad, self.told = bad, None

    def generate(self, system, user):
        batch = dict(re.findall(r"(?m)^\[(\d+)\] (.*)$", user))
        self.told = {"prompt_tokens": 10, "completion_tokens": "many", "cached_tokens": -1}
        return "{" if any(self.bad in t for t in batch.values()) else json.dumps({"translations": {k: v.upper() for k, v in batch.items()}})

    def usage(self):
        return self.told


class Silent:
    def generate(self, system, user):
        raise AssertionError("nobody is to be asked")

    def generate_with_image(self, user, image, mime):
        raise AssertionError("nobody is to be asked")


class Eye:
    def generate_with_image(self, user, image, mime):
        return '{"score": 0.9, "caption": "seen"}' if image == b"1" else "{"


@pytest.fixture(scope="module")
def books(spark):
    text = lambda i: F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(f" {i}"))
    rows = spark.range(60).select(F.lit("d").alias("doc"), F.lit(0).alias("chapter"), F.col("id").cast("int").alias("block_index"), F.lit("paragraph").alias("type"), text(0).alias("text"))
    shown = spark.createDataFrame([("d", 0, 60, "image", "one"), ("d", 0, 61, "image", "two")], "doc string, chapter int, block_index int, type string, image_id string")
    blocks = engine.S.whole(rows.unionByName(shown, allowMissingColumns=True)).drop("tokens")
    titles = spark.createDataFrame([("d", 0, "Title")], "doc string, chapter int, title string")
    images = spark.createDataFrame([("d", f"{i}.png", i, "image/png", None, "h", c) for i, c in (("one", b"1"), ("two", b"2"))], "doc string, path string, image_id string, mime string, alt string, sha256 string, content binary")
    about = spark.createDataFrame([("d", "T", None, "en", None)], "doc string, title string, author string, language string, cover string")
    return engine.Books(blocks, titles, images, about)


def test_translation_is_resumed(spark, books, tmp_path):
    log = f"{tmp_path}/log"
    first = engine.translate(books, Upper("text 50"), "Spanish", log_path=log)
    got = {r.block_index: r.text for r in first.books.blocks.where("type = 'paragraph'").collect()}
    assert got[0] == "TEXT 0 0" and got[50] == "text 50 0"
    assert [tuple(r) for r in first.reuse().collect()] == [("translate", 2, 0)]
    usage = first.usage().collect()[0]
    # The second batch is halved until the refused unit stands alone; counts that are no numbers are zeros.
    assert usage.calls > 2 and usage.prompt_tokens == 10 * usage.calls and usage.completion_tokens == usage.cached_tokens == 0
    second = engine.translate(books, Upper(), "Spanish", log_path=log, resume=True)
    assert [tuple(r) for r in second.reuse().collect()] == [("translate", 2, 1)]
    assert {r.block_index: r.text for r in second.books.blocks.where("type = 'paragraph'").collect()}[50] == "TEXT 50 0"
    third = engine.translate(books, Silent(), "Spanish", log_path=log, resume=True)
    assert [tuple(r) for r in third.reuse().collect()] == [("translate", 2, 2)] and third.usage().collect()[0].calls == 0
    assert engine.translate(books, Upper(), "French", log_path=log, resume=True).reuse().collect()[0].reused == 0


@pytest.mark.parametrize("said", ['{"0": "a"}', '{"0": "a", "1": "b", "2": "c"}', '{"0": "a", "1": 1}', '{"0": "a", "1": null}', '{"0": "a", "1"', "[]", None])
def test_stored_batches_need_exact_units(spark, said):
    units = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "chapter int, place int, text string")
    numbered = X.unit_batches(units, ["chapter"], "place")
    batches = X.batches_of(numbered, ["chapter"]).join(X.batch_fingerprints(numbered, ["chapter"], "es"), ["chapter", "batch_start"])
    log = batches.select("chapter", "batch_start", "fingerprint", F.lit(said).cast("string").alias("result"))
    assert X.stored_answers(batches, log, ["chapter"]).count() == 0
    whole = log.withColumn("result", F.lit('{"1": "b", "0": "a"}'))
    assert [r.said for r in X.stored_answers(batches, whole, ["chapter"]).collect()] == [{"0": "a", "1": "b"}]
    assert X.stored_answers(batches, whole.withColumn("fingerprint", F.lit("old")), ["chapter"]).count() == 0


def test_image_verdicts_are_resumed(spark, books, tmp_path):
    log = f"{tmp_path}/log"
    first = engine.judge_images(books, Eye(), log_path=log)
    assert {r.image_id: r.caption for r in first.books.blocks.where("type = 'image'").collect()} == {"one": "seen", "two": None}
    again = engine.judge_images(books, Eye(), log_path=log, resume=True)
    assert [tuple(r) for r in again.reuse().collect()] == [("images", 2, 1)] and again.usage().collect()[0].calls == 1
    changed = engine.Books(books.blocks, books.titles, books.images.where("image_id = 'one'"), books.about)
    assert engine.judge_images(changed, Silent(), log_path=log, resume=True).reuse().collect()[0].reused == 1
    other = engine.judge_images(changed, Eye(), model="other", log_path=log, resume=True)
    assert other.reuse().collect()[0].reused == 0


def test_counts_without_a_report():
    class Plain:
        def generate(self, system, user):
            return "x"

    counted = Counted(Plain())
    assert counted.generate("", "") == "x" and counted.taken() == [dict.fromkeys(USAGE, 0)] and counted.taken() == []


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k int, fingerprint string, result string")


def view(log, phase="p"):
    held = log.stored(phase, KEYS)
    return {} if held is None else {r.k: r.result for r in held.collect()}


def test_appends_are_ordered_by_number(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log", False)
    for n in range(3):
        log.append("p", rows(spark, (1, "f", f"v{n}"), (10 + n, "f", "x")))
    assert view(log) == {1: "v2", 10: "x", 11: "x", 12: "x"}
    assert Folders(spark, f"{tmp_path}/log/p").numbers() == [0, 2, 4]


def test_compaction_keeps_the_view_at_every_moment(spark, tmp_path, monkeypatch):
    log = Log(spark, f"{tmp_path}/log", False)
    for n in range(3):
        log.append("p", rows(spark, (n, "f", "own"), (9, "f", f"v{n}")))
    want = view(log)
    seen, write, delete = [], Folders.write, Folders.delete
    monkeypatch.setattr(Folders, "write", lambda s, r, n: (seen.append(view(log)), write(s, r, n), seen.append(view(log)))[1])
    monkeypatch.setattr(Folders, "delete", lambda s, n: (delete(s, n), seen.append(view(log)))[0])
    log.compact("p", KEYS)
    assert Folders(spark, f"{tmp_path}/log/p").numbers() == [0, 2, 4, 5] and view(log) == want
    log.append("p", rows(spark, (9, "f", "later")))
    assert view(log)[9] == "later"
    want = view(log)
    assert all(v[9] == "v2" for v in seen[:4])
    seen.clear()
    log.compact("p", KEYS, now=True)
    assert seen and all(v == want for v in seen) and Folders(spark, f"{tmp_path}/log/p").numbers() == [7]


def test_killed_compaction_loses_nothing(spark, tmp_path, monkeypatch):
    log = Log(spark, f"{tmp_path}/log", False)
    log.append("p", rows(spark, (1, "f", "a")))
    log.append("p", rows(spark, (1, "f", "b"), (2, "f", "c")))
    files = Folders(spark, f"{tmp_path}/log/p")
    # A draft that was never renamed isn't read.
    rows(spark, (1, "f", "torn")).write.parquet(f"{tmp_path}/log/p/_draft-x")
    assert view(log) == {1: "b", 2: "c"}
    # Killed while it deletes: some old folders are gone, the new one is there.
    monkeypatch.setattr(Folders, "delete", lambda s, n: None if n > 0 else (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        log.compact("p", KEYS, now=True)
    monkeypatch.undo()
    assert view(log) == {1: "b", 2: "c"} and 3 in files.numbers()


def test_stream_equals_batch_after_restart_and_late_files(spark, tmp_path):
    log, folder = Log(spark, f"{tmp_path}/log", False), f"{tmp_path}/files"
    schema = "k int, at int, result string"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        running = log.merged("p", KEYS, stream, f"{tmp_path}/checkpoint", "at")
        running.awaitTermination(120)
        return sorted(tuple(r) for r in log.view("p", KEYS, "at").select("k", "at", "result").collect())

    put((1, 5, "five"), (2, 1, "one"), (1, 4, "four"))
    put((1, 6, "six"))
    assert run() == [(1, 6, "six"), (2, 1, "one")]
    put((1, 3, "late"), (2, 2, "two"), (3, 1, "new"))  # a file that comes late, after a restart
    want = sorted(tuple(r) for r in last_rows(spark.read.schema(schema).parquet(folder), KEYS, "at").select("k", "at", "result").collect())
    assert run() == want == [(1, 6, "six"), (2, 2, "two"), (3, 1, "new")]
    assert run() == want


REPLIES = [
    '"a\\n\\nb"', '"a"', '""', '"a\\n \\n\\n b"', "[]", "{}", "3", "null", "[", None, '["a", "b"]', '["a", " "]', '[{"block": 2, "text": "m"}]', '[{"block": "1", "text": "a"}, {"block": " 2 ", "text": "b"}]',
    '[{"block": 2, "text": "a"}, {"block": 1, "text": "b"}]', '[{"block": true, "text": "a"}, {"text": "b"}]', '[{"block": 1.0, "text": "a"}]', '[{"block": 3, "text": "a"}]', '[{"block": 0, "text": "a"}]',
    '[{"block": 1, "type": null, "text": " a "}, {"block": 2, "type": "list", "items": ["x", " ", 3, true, null]}]', '[{"block": 1, "text": "a"}, {"block": 1, "text": "b"}, {"block": 2, "type": "quote", "text": "q"}]',
    '[{"block": 1, "text": "a"}, {"block": 2, "type": "quote", "text": 5}]', '[{"block": 2, "type": "list", "items": []}]', '["a", {"type": "quote", "text": "b"}]', '["a", {"type": "list", "items": ["i"]}]', '["a", "b", "c"]',
]


def test_reply_columns_equal_the_rules(spark):
    kinds = [["paragraph"], ["paragraph", "paragraph"], ["paragraph", "quote"], ["paragraph", "list"], ["list"], ["quote"]]
    table = spark.createDataFrame([(i, k, r) for i, (k, r) in enumerate((k, r) for k in kinds for r in REPLIES)], "i int, kinds array<string>, reply string")
    got = {r.i: r.pieces for r in RC.with_pieces(table, "kinds", "reply").collect()}
    for i, (k, r) in enumerate((k, r) for k in kinds for r in REPLIES):
        try:
            value = json.loads(r) if r is not None else None
        except ValueError:
            value = None
        want = read_reply(k, value)
        made = None if got[i] is None else [p.asDict() for p in got[i]]
        assert made == want, (k, r)


@pytest.mark.parametrize(("base", "href", "path"), [("OEBPS/text/a.xhtml", "../img/b c.png", "OEBPS/img/b c.png"), ("a.xhtml", "b.xhtml", "b.xhtml"), ("t/a", "../../x", None), ("a/b", "/etc/x", None), ("a", "..", None), ("t/a", "..", None), ("t/a", "./x//y/../z", "t/x/z")])
def test_paths_of_references(spark, base, href, path):
    assert spark.range(1).select(A.inside(F.lit(base), F.lit(href)).alias("p")).first()["p"] == path


def test_anchors_equal_the_walk(spark):
    """Names and targets of links as the reader of archives gives them."""
    from foliant.sources import epub as E
    from foliant.sources.tree import parse

    pages = [("t/a.xhtml", '<body><p id="x">1</p><h1 id="h">2</h1><a name="x">3</a></body>'), ("t/b.xhtml", "<body><p>no name</p></body>"), ("u/c d.xhtml", '<body><div id=" y "><a name="z">4</a></div></body>'), ("t/a.xhtml", '<body><p id="again">5</p></body>')]
    walked = E.Anchors(pages)
    elements = []
    for spine, (path, markup) in enumerate(pages):
        for pos, node in enumerate(parse(markup).first("body").descendants()):
            elements.append(("b", spine, path, pos, node.tag, E.named_place(node)))
    table = A.anchor_table(spark.createDataFrame(elements, "book string, spine int, path string, pos int, tag string, place string"), spark.createDataFrame([("b", i, p) for i, (p, _) in enumerate(pages)], "book string, spine int, path string"))
    got = {(r.path, r.place): r.anchor_id for r in table.collect()}
    assert {k: v for k, v in got.items() if k[1]} == walked.places and {k[0]: v for k, v in got.items() if k[1] is None} == walked.spare
    hrefs = ["#x", "#none", "b.xhtml", "../u/c%20d.xhtml#z", "../u/c d.xhtml", "a.xhtml#h?q", "https://h/x", "MAILTO:me", "../../x", "", "#", "a.xhtml", "b.xhtml#x", "a.xhtml?q#h"]
    links = spark.createDataFrame([("b", "t/a.xhtml", h) for h in hrefs], "book string, path string, href string")
    resolve = walked.resolver("t/a.xhtml")
    # A path that the spine has twice counts where it is first; the walk lets the later one win, so it isn't asked here.
    assert {r.href: r.target for r in A.resolved(links, table).collect() if r.href not in ("a.xhtml",)} == {h: resolve(h) for h in hrefs if h not in ("a.xhtml",)}


def test_class_styles_equal_the_scanner(spark):
    from foliant.functions import styles
    from foliant.operators import cascade

    sheets = ["/* .z{color:red} */ .a, p.b, .c { font-style: italic; color: #ABC } .a{font-weight:bold;color:blue} .d{margin:0} .l{list-style: inside url(x) circle}", "@media print { .a { text-align: right } } .c{color: url(x); text-decoration: none line-through;} .e{list-style-type: Disc} .e{list-style-image: url(y)} .f{font-weight: 900; font-weight: 400}", ".a{color:red", ".g{color:expression(1)} .h{list-style-image:none} } .i{color:rgba(1,2,3,.5)}"]
    table = spark.createDataFrame([("b", i, s) for i, s in enumerate(sheets)], "book string, sheet int, css string")
    assert {r["class"]: r.styles for r in cascade.class_styles(table).collect()} == styles.merged(sheets)


def test_files_come_all_or_none(spark, tmp_path):
    from foliant.sources.files import store

    files = spark.createDataFrame([("a.md", bytearray(b"1")), ("images/b c.png", bytearray(b"2")), ("e.md", None)], "file string, content binary").repartition(3)
    store(files, f"{tmp_path}/out")
    assert (tmp_path / "out/a.md").read_bytes() == b"1" and (tmp_path / "out/images/b c.png").read_bytes() == b"2" and (tmp_path / "out/e.md").read_bytes() == b""
    store(files.where("file = 'a.md'").withColumn("content", F.lit(b"3")), f"file://{tmp_path}/out")  # replaces its own
    assert (tmp_path / "out/a.md").read_bytes() == b"3"
    # One task fails, or a name leads out of the folder: no file at all.
    bad = files.unionByName(spark.createDataFrame([("../up.md", bytearray(b"4"))], "file string, content binary"))
    with pytest.raises(Exception, match="no name for a file"):
        store(bad, f"{tmp_path}/none")
    held = [p for p in (tmp_path / "none").rglob("*")] if (tmp_path / "none").exists() else []
    assert held == [] and not (tmp_path / "up.md").exists()


def test_progress_is_told(spark, books, tmp_path):
    told = []
    engine.translate(books, Upper(), "Spanish", log_path=f"{tmp_path}/log", tell=lambda *a: told.append(a))
    engine.translate(books, Silent(), "Spanish", log_path=f"{tmp_path}/log", resume=True, tell=lambda *a: told.append(a))
    assert told == [("translate", {"rows": 61, "reused": 0, "calls": 2}), ("translate", {"rows": 61, "reused": 61, "calls": 0})]


@pytest.mark.parametrize("sizes", [(0, 1, 5, 30), (1,), (0,), (90, 200, 0), (100,), (101, 1, 0)])
def test_chunks_of_long_chapters(spark, sizes):
    import random

    from foliant.operators.blocks import _chunk_numbers
    from foliant.operators.long_chapters import chunk_table

    rng = random.Random(len(sizes))
    rows = [(c, i, rng.choice(sizes)) for c, n in ((1, 700), (2, 1), (3, 40)) for i in range(n)]
    table = spark.createDataFrame(rows, "chapter int, block_index int, tokens int").repartition(5)
    got = {(r.chapter, r.block_index): r.chunk_no for r in chunk_table(table, ["chapter"], ["block_index"], 100).collect()}
    import numpy as np

    for c in (1, 2, 3):
        own = [t for k, _, t in rows if k == c]
        assert [got[c, i] for i in range(len(own))] == _chunk_numbers(np.array(own), 100)
    assert chunk_table(table.where("false"), ["chapter"], ["block_index"], 100).count() == 0
