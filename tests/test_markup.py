"""Markup, styles, links and renderers: golden cases."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import styles as S
from foliant.operators import links as L, render as R, stages as ST
from foliant.sources import epub as E, html as H, tree


@pytest.mark.parametrize(
    ("raw", "kept"),
    [
        ('<i>a</i> <b>b</b><u>c</u>', "<em>a</em> <strong>b</strong>c"),
        ('x <script>bad</script><style>p{}</style><title>t</title><embed>y', "x y"),
        ('<a href="http:x">a</a><a href="//h">b</a><a href="#f">c</a><a href="javascript:x">d</a>', "abcd"),
        ('<a href="HTTPS://h?a=1&amp;b">a</a><a href="mailto:x">b</a>', '<a href="HTTPS://h?a=1&amp;b">a</a><a href="mailto:x">b</a>'),
        ('<a href="bbref:a1">a</a><a href="bbref:1a">b</a><a href="bbref:">c</a>', '<a href="bbref:a1">a</a>bc'),
        ('<span style="color: Red; x:y">a</span><span style="color:url(x)">b</span>', '<span style="color:red">a</span>b'),
        ('<span style="font-style:italic;font-weight:700;text-decoration:line-through">a</span>', "<strong><em><s>a</s></em></strong>"),
        ("a<br>b <sup>2</sup><sub></sub> <del>c</del>", "a<br/>b <sup>2</sup> <s>c</s>"),
        ('<img src="x.png"><img data-image-id="i&quot;1">', '<img data-image-id="i&quot;1"/>'),
        (" a \n\t b &lt;c&gt; ", "a b &lt;c&gt;"),
        ("", ""), (None, None),
    ],
)
def test_clean(raw, kept):
    assert H.clean(raw) == kept


def test_clean_is_stable():
    raw = '<p>a <b>b<i>c</i></b> <a href="https://x">d</a><br>&amp; <span style="color:#abc">e</span></p>'
    assert H.clean(H.clean(raw)) == H.clean(raw)


def test_deep_markup_is_taken_apart():
    assert H.clean("<b>" * 5000 + "x" + "</b>" * 5000).count("<strong>") <= tree.DEEPEST
    assert H.walk("<div>" * 3000 + "<p>x</p>")[0]["text"] == "x"


def test_class_rules():
    sheet = "/* .z{color:red} */ .a, p.b, .c { font-style: italic; color: #ABC } .a{font-weight:bold;color:blue} .d{margin:0} .l{list-style: inside url(x) circle}"
    assert S.class_rules(sheet) == {"a": {"italic": "1", "color": "blue", "bold": "1"}, "c": {"italic": "1", "color": "#abc"}, "l": {"marker": "square"}}
    assert S.merged([".a{color:red;text-align:center}", ".a{color:blue}"]) == {"a": {"color": "blue", "align": "center"}}


@pytest.mark.parametrize(("style", "marker"), [("list-style-type: Disc", "disc"), ("list-style: inside square", "square"), ("list-style-image:url(x)", "square"), ("list-style-image:none", None), ("list-style-type:roman", None)])
def test_markers(style, marker):
    assert S.declared(style).get("marker") == marker


def test_walk_passes_on_and_captions():
    got = H.walk('<div style="text-align:center"><p>a</p></div><div style="text-align:center"><p>b</p><p>c</p></div><p style="text-align:right">d</p>'
                 '<ul class=l style="list-style-type:circle;color:red"><li>x<li><b>y</b></ul><figure style="text-align:left"><img src="f/a.png" alt="alt"><figcaption>Cap <i>z</i></figcaption></figure>'
                 '<p><img src="b.png" alt=" Image "></p><p>t<img src="c.png">u</p><pre>k  <b>l</b>\n</pre><table><tr><td> a <i>b</i></td></tr><tr></tr></table>bare')  # fmt: skip
    assert [b.get("align") for b in got[:4]] == ["center", None, None, "right"]
    assert got[4] == {"type": "list", "items": ["x", "y"], "items_rich": ["x", "<strong>y</strong>"], "ordered": False, "marker_type": "circle", "marker_color": "red", "anchor_id": None}
    assert (got[5]["image_id"], got[5]["caption"], got[5]["align"]) == ("a.png", "Cap z", "left")
    assert (got[6]["image_id"], got[6]["caption"]) == ("b.png", None)
    assert got[7]["text"] == "t u" and got[8]["text"] == "k  l\n" and got[9]["rows"] == [["a b"]] and len(got) == 10


def book(files):
    items = "".join(f'<item id="{n}" href="{href}" media-type="{mime}"/>' for n, href, mime, _ in files)
    spine = "".join(f'<itemref idref="{n}"/>' for n, _, mime, _ in files if "html" in mime)
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(E.CONTAINER, '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", f'<package><metadata><title>T</title><title>U</title><meta name="cover" content="cov"/></metadata><manifest>{items}<item id="cov" href="img/cov.png" media-type="image/png"/></manifest><spine>{spine}<itemref idref="gone"/></spine></package>')
        z.writestr("O/img/cov.png", b"c")
        for _, href, _, data in files:
            z.writestr(f"O/{href}", data)
    return out.getvalue()


PAGES = [
    ("s", "s.css", "text/css", ".it{font-style:italic}"),
    ("i", "img/i.png", "image/png", "1"),
    ("a", "t/a.xhtml", "application/xhtml+xml", '<body><h1 id="top">One</h1><p><a name="n1"></a>see <a href="b.xhtml#x">b</a>, <a href="b.xhtml">file</a>, <a href="#n1">here</a>, <a href="../../../e">out</a>, <a href="c.xhtml">c</a> <span class="it">k</span></p><p id="pic"><img src="../img/i.png" alt="Fig"></p></body>'),
    ("b", "t/b.xhtml", "application/xhtml+xml", '<body><div id="x"><p>two</p></div><p>in <img src="../img/i.png"> <img src="no.png"></p></body>'),
    ("c", "t/c.xhtml", "application/xhtml+xml", "<head><title> Last </title></head><body><p>three</p></body>"),
]


def test_anchors_links_styles_and_images_of_a_book():
    b = E.Book(book(PAGES))
    chapters = list(b.chapters())
    assert b.title == "U" and [t for _, t, _ in chapters] == ["One", None, "Last"]
    one, two, three = (blocks for *_, blocks in chapters)
    assert one[0]["anchor_id"] == "a1" and two[0]["anchor_id"] == "a4" and three[0]["anchor_id"] == "a5"
    assert one[1]["rich"] == 'see <a href="bbref:a4">b</a>, <a href="bbref:a4">file</a>, <a href="bbref:a2">here</a>, out, <a href="bbref:a5">c</a> <em>k</em>'
    assert (one[2]["type"], one[2]["image_id"], one[2]["caption"]) == ("image", "i", "Fig")
    assert two[1]["rich"] == 'in <img data-image-id="i"/>'
    assert [(r[1], r[3]) for r in b.image_rows()] == [("i", "Fig"), ("cov", None)]


def test_hostile_image_fails_the_book():
    files = [*PAGES[:2], ("a", "t/a.xhtml", "application/xhtml+xml", '<body><p>x <img src="../../../etc/x"></p></body>')]
    assert len(list(E.Book(book(files)).chapters())) == 1
    files[-1] = ("a", "t/a.xhtml", "application/xhtml+xml", '<body><img src="../../../etc/x"></body>')
    with pytest.raises(ValueError, match="leaves"):
        list(E.Book(book(files)).chapters())


@pytest.mark.parametrize(
    ("rich", "out"),
    [
        ('<a href="bbref:a1">x <em>y</em></a> <a href="https://h">z</a> <a href="bbref:a9">w</a>', '<a href="#a1">x <em>y</em></a> <a href="https://h">z</a> w'),
        ('<a href="bbref:a9">p <a href="bbref:a1">q</a> r</a>', 'p <a href="#a1">q</a> r'), ("plain", "plain"),
    ],
)
def test_rewrite(rich, out):
    assert L.rewrite(rich, {"a1": "#a1"}) == out


@pytest.mark.parametrize(
    ("rich", "out"),
    [
        ("<em>a</em> <strong>b</strong> <code>c&lt;d</code><br/>e", "*a* **b** `c<d`  \ne"),
        ('<a href="https://h">x</a> <a href="bbref:a1">y <em>z</em></a>', "[x](https://h) y *z*"),
        ('<span style="color:red">q <a href="bbref:a1">y</a></span><s>k</s>', '<span style="color:red">q y</span><s>k</s>'),
        ('<img data-image-id="i"/><img data-image-id="no"/>', "![](images/i.png)"),
    ],
)
def test_inline_markdown(rich, out):
    assert R.to_inline_markdown(rich, {"i": "images/i.png"}) == out


def test_html_of_every_kind(spark):
    rows = [
        {"type": "heading", "level": 2, "text": "T", "rich": "<em>T</em>", "align": "center", "anchor_id": "a1"},
        {"type": "code", "text": "a<b", "language": "py"}, {"type": "code", "text": "x"},
        {"type": "list", "items": ["a", "b"], "items_rich": ["a", "<strong>b</strong>"], "ordered": True, "marker_type": "square", "marker_color": "#a b"},
        {"type": "table", "rows": [["H"], ["<d>"]]}, {"type": "quote", "text": "q"},
        {"type": "image", "image_id": "i", "caption": "c", "align": "left"}, {"type": "image", "image_id": "gone"},
        {"type": "paragraph", "text": "p", "rich": 'p <img data-image-id="i"/><br/><img data-image-id="gone"/>z'},
    ]
    blocks = spark.createDataFrame([(1, 0, i, *(r.get(f) for f in ST.FIELDS)) for i, r in enumerate(rows)], "doc int, chapter int, block_index int, " + ST.BLOCK)
    address = spark.createDataFrame([(1, "i", "images/i.png")], "doc int, image_id string, address string")
    got = R.to_html(R.with_links(blocks, address, ["doc"]), ["doc"]).first()["html"].split("\n")
    assert got == [
        '<h2 id="a1" style="text-align:center"><em>T</em></h2>', '<pre><code class="language-py">a&lt;b</code></pre>', "<pre><code>x</code></pre>",
        '<style>.mark-ab>li::marker{color:#a b}</style><ol class="mark-ab" style="list-style-type:square"><li>a</li><li><strong>b</strong></li></ol>',
        "<table><tr><th>H</th></tr><tr><td>&lt;d&gt;</td></tr></table>", "<blockquote>q</blockquote>",
        '<figure style="text-align:left"><img src="images/i.png" alt="c"/><figcaption>c</figcaption></figure>', "",
        '<p>p <img src="images/i.png" alt=""/><br/>z</p>',
    ]


@pytest.mark.parametrize(("asked", "out"), [(["MD", " epub", "md"], ["md", "epub"]), (["x"], None), ([], None)])
def test_formats(asked, out):
    if out is None:
        with pytest.raises(ValueError):
            R.formats(asked)
    else:
        assert R.formats(asked) == out


def test_formats_fail_alone():
    def broken():
        raise RuntimeError("no library")

    assert R.each(["pdf", "md"], {"pdf": broken, "md": lambda: 1}) == ({"md": 1}, ["pdf: skipped: no library"])


def test_signature_and_ids(spark):
    rich = '<em>a</em><a href="https://h?x&amp;y">b</a><span style="color:red">c</span><br/><img data-image-id="i&amp;1"/>'
    row = spark.range(1).select(H.tag_signature(F.lit(rich)).alias("s"), H.inline_image_ids(F.lit(rich)).alias("i"), H.strip_tags(F.lit("a<br/>b &lt;c&gt;")).alias("t")).first()
    assert row["s"] == ["a:https://h?x&y", "br", "em", "img:i&1", "span:color:red"] and row["i"] == ["i&1"] and row["t"] == "a b <c>"


def test_xml_ids():
    assert E.xml_ids(["img-1", "img 1", "img-1", "9x", ""]) == ["img-1", "img_1", "img-1-2", "id-9x", "id"]
