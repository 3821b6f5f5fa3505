"""Golden values and small cases of the operators."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import cost, text as T
from foliant.operators import blocks as B, render as C
from foliant.sources import html as H
from foliant.streaming import checkpoint as K


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_chunks_count_blocks_not_tokens(spark):
    tokens = F.array(*map(F.lit, (0, 9, 1)))
    assert one(spark, B.chunk_numbers(tokens, 6)) == [1, 2, 3]
    assert one(spark, B.chunk_numbers(F.array(*map(F.lit, (3, 3, 1, 20, 2))), 6)) == [1, 1, 2, 3, 4]
    assert one(spark, B.chunk_numbers(F.array().cast("array<int>"), 6)) == []


def test_cost_golden(spark):
    c = cost.condense_traffic(F.lit(215771), F.lit(51), F.lit(134), 0.30)
    assert [one(spark, c[k]) for k in ("prompt_tokens", "completion_tokens", "calls")] == [496640, 302997, 210]
    assert one(spark, cost.translate_traffic(F.lit(100), F.lit(800))["calls"]) == 20
    assert [one(spark, cost.target_tokens(F.lit(n), 0.3)) for n in (50, 2000, 400)] == [100, 600, 120]


def test_fingerprint_golden(spark):
    assert one(spark, T.fingerprint(F.lit("field1"), F.lit("field2"))) == "b44dc7b8e55c2c1567f7a477547bd5f59e371426"


@pytest.mark.parametrize(("text", "tokens"), [("", 0), ("a", 1), ("abcdefgh", 2), ("😀" * 9, 2)])
def test_tokens(spark, text, tokens):
    assert one(spark, T.count_tokens(F.lit(text))) == tokens


def test_json_object(spark):
    fenced = F.lit('```json\n{"texts": {"1": "a"}}\n``` done')
    assert one(spark, F.try_variant_get(T.json_object(fenced), "$.texts['1']", "string")) == "a"
    assert one(spark, T.json_object(F.lit("[1]")).isNull())
    assert one(spark, T.json_object(F.lit("none")).isNull())


def test_markdown_of_every_type(spark):
    schema = "k int, block_index int, type string, level int, text string, items array<string>, ordered boolean, rows array<array<string>>, language string, caption string, link string"
    rows = [
        (1, 0, "heading", 2, "T", None, None, None, None, None, None),
        (1, 1, "code", None, "x = 1\n\n", None, None, None, "python", None, None),
        (1, 2, "list", None, None, ["a", "b"], True, None, None, None, None),
        (1, 3, "table", None, None, None, None, [["N", "V"], ["a|b", "1"]], None, None, None),
        (1, 4, "quote", None, "p\nq", None, None, None, None, None, None),
        (1, 5, "image", None, None, None, None, None, None, "cap", "i.png"),
    ]
    got = C.to_markdown(spark.createDataFrame(rows, schema), ["k"]).first()["markdown"]
    assert got == "## T\n\n```python\nx = 1\n```\n\n1. a\n2. b\n\n| N | V |\n| --- | --- |\n| a\\|b | 1 |\n\n> p\n> q\n\n![cap](i.png)\n"


def test_html_walk():
    got = H.walk("<title>t</title><div>bare</div><h1>H <b>x</b></h1><p>one<p>two<br>three<ul><li>a</li><li> </li><li>b</ul><pre><code class='language-py'>x\n</code></pre><table><tr><th>A</th></tr></table>")
    assert [b["type"] for b in got] == ["heading", "paragraph", "paragraph", "list", "code", "table"]
    assert got[0]["text"] == "H x" and got[2]["text"] == "two three" and got[3]["items"] == ["a", "b"] and got[4]["language"] == "py"


def test_sanitize():
    assert H.clean('<i>a</i><script>x</script><a href="javascript:1">b</a><a href="https://c">c</a><u>d</u><b>e') == '<em>a</em>b<a href="https://c">c</a>d<strong>e</strong>'


def test_log_keeps_last_whole_lines(spark):
    lines = ['{"chunk_id": "a", "result": {"n": 1}}', "", '{"chunk_id": "a", "res', '{"chunk_id": "a", "result": {"n": 2}}', '{"chunk_id": 3, "result": {}}', '{"chunk_id": "b", "result": 5}']
    df = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, seq int")
    got = K.last_writes(K.parse_log(df), ["key"], "seq", "result").collect()
    assert [(r["key"], r["result"]) for r in got] == [("a", '{"n":2}')]
