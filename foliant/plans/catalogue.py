"""Named queries with their DuckDB equivalents.

Books are the sources of `documents`, chapters its rows, blocks their lines with text (paragraphs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from foliant.functions import cost, prompts as P, provider as PR, text as T
from foliant.operators import blocks as B, condense as C, links as L, render as RD, replies as R, stages as S, translate as X, vision as V
from foliant.sources import epub as E, html as H, pdf as PDF
from foliant.streaming import checkpoint as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RATIO, CHUNK = 0.3, 500

LINES = """lines AS (SELECT source AS book, doc_id AS chapter, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS block_index, text,
  CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens
  FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
  WHERE trim(text, ' ') <> '')"""
CHUNKS = f"""RECURSIVE {LINES}, greedy AS (
  SELECT book, chapter, block_index, text, tokens, tokens AS held, 1 AS chunk_no FROM lines WHERE block_index = 0
  UNION ALL SELECT l.book, l.chapter, l.block_index, l.text, l.tokens,
    CASE WHEN g.held + l.tokens > {CHUNK} THEN l.tokens ELSE g.held + l.tokens END,
    CASE WHEN g.held + l.tokens > {CHUNK} THEN g.chunk_no + 1 ELSE g.chunk_no END
  FROM greedy g JOIN lines l ON l.chapter = g.chapter AND l.block_index = g.block_index + 1)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def title() -> Column:
    return F.concat(F.lit("Chapter "), F.col("doc_id").cast("string"))


@query(f"""WITH {LINES} SELECT d.source AS book, (SELECT coalesce(sum(tokens), 0) FROM lines WHERE book = d.source)::BIGINT AS block_tokens,
  sum(greatest(1, length('Chapter ' || d.doc_id) // 4))::BIGINT AS title_tokens FROM documents d GROUP BY d.source""")
def doc_token_counts(spark, d):
    own = docs(spark, d).select(F.col("source").alias("book"), T.count_tokens(title()).alias("title"), F.aggregate(T.lines_of(F.col("text")), F.lit(0).cast("long"), lambda s, x: s + T.count_tokens(x)).alias("t"))
    return own.groupBy("book").agg(F.sum("t").alias("block_tokens"), F.sum("title").cast("long").alias("title_tokens"))


@query(f"WITH {CHUNKS} SELECT book, chapter, block_index, chunk_no FROM greedy")
def greedy_chunks(spark, d):
    return B.chunked(docs(spark, d), CHUNK).select("book", "chapter", "block_index", "chunk_no")


@query(f"WITH {CHUNKS} SELECT chapter, 'ch' || chapter || '-' || chunk_no AS chunk_id, count(*) AS blocks, sum(tokens)::BIGINT AS token_count FROM greedy GROUP BY chapter, chunk_no")
def chunk_summary(spark, d):
    g = B.chunked(docs(spark, d), CHUNK).groupBy("chapter", "chunk_no").agg(F.count("*").alias("blocks"), F.sum("tokens").alias("token_count"))
    return g.select("chapter", F.format_string("ch%s-%s", F.col("chapter").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"), "blocks", "token_count")


@query(f"""WITH {CHUNKS}, last AS (SELECT book, chapter, chunk_no, arg_max(text, block_index) AS t FROM greedy GROUP BY ALL)
  SELECT book, chapter, chunk_no, right(trim(lag(t) OVER (PARTITION BY book, chapter ORDER BY chunk_no), ' '), 400) AS prev_context FROM last""")
def chunk_prev_context(spark, d):
    return B.previous_context(B.chunked(docs(spark, d), CHUNK))


@query(f"WITH {LINES} SELECT chapter, sum(tokens)::BIGINT AS input_tokens, greatest(round_even(sum(tokens) * {RATIO}::DOUBLE, 0)::BIGINT, 100) AS target_tokens FROM lines GROUP BY chapter")
def chapter_budget(spark, d):
    g = B.paragraphs(docs(spark, d)).groupBy("chapter").agg(F.sum("tokens").alias("input_tokens"))
    return g.select("chapter", "input_tokens", cost.target_tokens(F.col("input_tokens"), RATIO).alias("target_tokens"))


_BOOKS = f"""WITH {CHUNKS}, b AS (SELECT book, count(DISTINCT chapter) AS chapters, count(DISTINCT (chapter, chunk_no)) AS chunks, sum(tokens)::DOUBLE AS n FROM greedy GROUP BY book)"""


@query(f"""{_BOOKS}, c AS (SELECT *, n * {RATIO}::DOUBLE * 1.3::DOUBLE AS c, n * {RATIO}::DOUBLE * 1.3::DOUBLE * 0.9::DOUBLE AS s FROM b)
  SELECT book, n::BIGINT AS input_tokens, chapters, chunks,
  round_even((n + 900 * chunks) + (c + 500 * chapters) + (s * 0.5::DOUBLE + 500 * (chapters * 0.5::DOUBLE)), 0)::BIGINT AS prompt_tokens,
  round_even(c * 1.55::DOUBLE + s * 1.55::DOUBLE + s * 0.5::DOUBLE * 0.94::DOUBLE * 1.55::DOUBLE, 0)::BIGINT AS completion_tokens,
  round_even(chunks + chapters + chapters * 0.5::DOUBLE, 0)::BIGINT AS calls, greatest(1, round_even(n / 450, 0)::BIGINT) AS pages,
  round_even(n * {RATIO}::DOUBLE, 0)::BIGINT AS estimated_output_tokens FROM c""")
def dry_run_estimate(spark, d):
    g = B.chunked(docs(spark, d), CHUNK).groupBy("book", "chapter").agg(F.max("chunk_no").alias("chunks"), F.sum("tokens").alias("n"))
    g = g.groupBy("book").agg(F.sum("n").alias("input_tokens"), F.count("*").alias("chapters"), F.sum("chunks").alias("chunks"))
    n = F.col("input_tokens")
    return g.select("book", "input_tokens", "chapters", "chunks", *(c.alias(k) for k, c in cost.condense_traffic(n, F.col("chapters"), F.col("chunks"), RATIO).items()), cost.pages(n).alias("pages"), F.rint(n.cast("double") * RATIO).cast("long").alias("estimated_output_tokens"))


@query(f"""WITH {LINES}, u AS (SELECT book, sum(tokens)::DOUBLE AS n, count(*) + count(DISTINCT chapter) AS units FROM lines GROUP BY book)
  SELECT book, units, round_even(n + 500 * ceil(units / 40.0), 0)::BIGINT AS prompt_tokens, round_even(n * 1.15::DOUBLE * 1.55::DOUBLE, 0)::BIGINT AS completion_tokens, ceil(units / 40.0)::BIGINT AS calls FROM u""")
def translate_estimate(spark, d):
    g = B.paragraphs(docs(spark, d)).groupBy("book", "chapter").agg(F.sum("tokens").alias("n"), (F.count("*") + 1).alias("u")).groupBy("book").agg(F.sum("n").alias("n"), F.sum("u").alias("units"))
    return g.select("book", "units", *(c.alias(k) for k, c in cost.translate_traffic(F.col("n"), F.col("units")).items()))


@query(f"WITH {LINES} SELECT chapter, block_index, block_index // 40 * 40 AS batch_start, 'tr:' || chapter || ':' || (block_index // 40 * 40) AS batch_key FROM lines")
def translate_batches(spark, d):
    u = B.unit_batches(B.paragraphs(docs(spark, d)), ["chapter"], "block_index")
    return u.select("chapter", "block_index", "batch_start", F.concat(F.lit("tr:"), F.col("chapter").cast("string"), F.lit(":"), F.col("batch_start").cast("string")).alias("batch_key"))


# Every third line stands for another type, so that runs break.
_TYPED = f"""WITH {LINES}, typed AS (SELECT chapter, block_index, text, CASE WHEN block_index % 7 = 0 THEN 'heading' WHEN block_index % 7 = 3 THEN 'code' WHEN block_index % 7 = 5 THEN 'image' WHEN block_index % 7 = 6 THEN 'quote' ELSE 'paragraph' END AS type FROM lines),
  r AS (SELECT *, type IN ('paragraph', 'quote', 'list') AS prose FROM typed), s AS (SELECT *, prose AND NOT coalesce(lag(prose) OVER (PARTITION BY chapter ORDER BY block_index), false) AS st FROM r),
  runs AS (SELECT chapter, block_index, text, type, CASE WHEN prose THEN 'text' WHEN type = 'image' THEN 'image' ELSE 'keep' END AS kind, CASE WHEN prose THEN sum(st::INT) OVER (PARTITION BY chapter ORDER BY block_index) END::INT AS run_id FROM s)"""


def typed(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("block_index") % 7
    kind = F.when(i == 0, "heading").when(i == 3, "code").when(i == 5, "image").when(i == 6, "quote").otherwise("paragraph")
    return B.paragraphs(docs(spark, d)).select("chapter", "block_index", "text", kind.alias("type"))


@query(f"{_TYPED} SELECT chapter, block_index, kind, coalesce(run_id, 0) AS run_id FROM runs")
def segment_runs(spark, d):
    return B.runs(typed(spark, d), ["chapter"]).select("chapter", "block_index", "kind", F.coalesce("run_id", F.lit(0)).alias("run_id"))


@query(f"""{_TYPED}, n AS (SELECT *, row_number() OVER (PARTITION BY chapter, run_id ORDER BY block_index) AS k FROM runs WHERE run_id IS NOT NULL)
  SELECT chapter, run_id, string_agg('[BLOCK ' || k || ' type=' || type || ']' || chr(10) || text, chr(10) ORDER BY k) AS body FROM n GROUP BY chapter, run_id""")
def run_serialize(spark, d):
    return C.serialize_runs(B.runs(typed(spark, d), ["chapter"]), ["chapter"])


@query(f"""{_TYPED} SELECT chapter, block_index, last_value(CASE WHEN type IN ('heading', 'paragraph', 'quote') THEN text END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(CASE WHEN type IN ('heading', 'paragraph', 'quote') THEN text END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY block_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM runs QUALIFY type = 'image'""")
def nearest_text_context(spark, d):
    return B.nearest_text(typed(spark, d), ["chapter"]).where("type = 'image'").select("chapter", "block_index", "before", "after")


_PRINT = f"WITH {CHUNKS}, p AS (SELECT chapter, chunk_no, sha1('v1' || chr(0) || '0.3' || chr(0) || string_agg(text, chr(10) ORDER BY block_index) || chr(0)) AS fingerprint FROM greedy GROUP BY chapter, chunk_no)"


def _fingerprints(spark, d):
    g = B.chunked(docs(spark, d), CHUNK).groupBy("chapter", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("block_index", "text"))).alias("b"))
    return g.select("chapter", "chunk_no", T.fingerprint(F.lit("v1"), F.lit("0.3"), F.array_join(F.col("b.text"), "\n")).alias("fingerprint"))


@query(f"{_PRINT} SELECT * FROM p")
def fingerprint_chunks(spark, d):
    return _fingerprints(spark, d)


# The log of an earlier run: even chapters, of which those divisible by 4 have changed since.
_LOG = "log AS (SELECT chapter, chunk_no, CASE WHEN chapter % 4 = 0 THEN 'old' ELSE fingerprint END AS fingerprint FROM p WHERE chapter % 2 = 0)"


def _earlier(p: DataFrame) -> DataFrame:
    return p.where("chapter % 2 = 0").withColumn("fingerprint", F.when(F.col("chapter") % 4 == 0, "old").otherwise(F.col("fingerprint")))


@query(f"{_PRINT}, {_LOG} SELECT p.chapter, p.chunk_no FROM p JOIN log USING (chapter, chunk_no, fingerprint)")
def resume_cache_hits(spark, d):
    p = _fingerprints(spark, d)
    return K.reuse(p, _earlier(p), ["chapter", "chunk_no"])[0].select("chapter", "chunk_no")


@query(f"{_PRINT}, {_LOG} SELECT p.chapter, p.chunk_no FROM p ANTI JOIN log USING (chapter, chunk_no, fingerprint)")
def resume_cache_misses(spark, d):
    p = _fingerprints(spark, d)
    return K.reuse(p, _earlier(p), ["chapter", "chunk_no"])[1].select("chapter", "chunk_no")


@query("SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events GROUP BY user_id, event_type")
def checkpoint_last_write_wins(spark, d):
    return K.last_writes(table(spark, d, "events"), ["user_id", "event_type"], "event_id", "props")


@query("SELECT event_id, CASE WHEN props LIKE '%{%' THEN json_extract_string('{' || split_part(props, '{', 2), '$.k') END AS k FROM events")
def checkpoint_json_decode(spark, d):
    v = T.json_object(F.concat(F.lit("```json\n"), "props", F.lit("\n``` done")))
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"))


_IMG = "a AS (SELECT source AS doc, 'img' || (doc_id % 97) AS image_id, min(doc_id) AS first FROM documents GROUP BY ALL), r AS (SELECT DISTINCT source AS doc, 'img' || (doc_id * 2 % 202) AS image_id FROM documents)"


def _images(spark, d):
    name = lambda n: F.concat(F.lit("img"), n.cast("string")).alias("image_id")
    x = docs(spark, d)
    assets = x.groupBy(F.col("source").alias("doc"), name(F.col("doc_id") % 97)).agg(F.min("doc_id").alias("first"))
    return B.select_assets(assets, x.select(F.col("source").alias("doc"), name(F.col("doc_id") * 2 % 202)).distinct())


@query(f"WITH {_IMG} SELECT a.* FROM a SEMI JOIN r USING (doc, image_id)")
def image_select_kept(spark, d):
    return _images(spark, d)[0]


@query(f"WITH {_IMG} SELECT a.* FROM a ANTI JOIN r USING (doc, image_id)")
def image_select_dropped(spark, d):
    return _images(spark, d)[1]


@query(f"WITH {_IMG} SELECT r.* FROM r ANTI JOIN a USING (doc, image_id)")
def image_select_dangling(spark, d):
    return _images(spark, d)[2]


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS parsed, coalesce(l.quality::DOUBLE >= 0.5, true) AS keep FROM documents d LEFT JOIN labels l USING (doc_id)")
def vision_keep(spark, d):
    v = table(spark, d, "labels").select("doc_id", F.coalesce(F.try_to_number(F.col("quality").cast("string"), F.lit("9")).cast("double"), F.lit(0.0)).alias("score"), F.lit(True).alias("parsed"))
    keep = F.coalesce((F.col("score") >= 0.5) & ~F.isnan("score"), F.lit(True))
    return docs(spark, d).join(v, "doc_id", "left").select("doc_id", F.coalesce("parsed", F.lit(False)).alias("parsed"), keep.alias("keep"))


@query("""WITH m AS (SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN 'gemini-3.6-flash' WHEN 1 THEN 'openai/gpt-5.6-luna' ELSE 'other/model' END AS model FROM conversations),
  c(model, ask, over) AS (VALUES ('gemini-3.6-flash', 0.85::DOUBLE, 1.3::DOUBLE), ('openai/gpt-5.6-luna', 0.67::DOUBLE, 1.3::DOUBLE))
  SELECT model, coalesce(ask, 1.0::DOUBLE) AS ask_factor, coalesce(over, 1.3::DOUBLE) AS overshoot, ask IS NOT NULL AS calibrated, count(*) AS conversations FROM m LEFT JOIN c USING (model) GROUP BY ALL""")
def calibration_lookup(spark, d):
    """What is known of the models that conversations are held with."""
    n = F.col("conv_id") % 3
    model = F.when(n == 0, "gemini-3.6-flash").when(n == 1, "openai/gpt-5.6-luna").otherwise("other/model")
    held = table(spark, d, "conversations").select("conv_id").distinct().select(model.alias("model"))
    return cost.calibrated(held, spark).groupBy("model", "ask_factor", "overshoot", "calibrated").agg(F.count("*").alias("conversations"))


@query("""SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS calls, coalesce(sum(greatest(1, length(text) // 4)) FILTER (WHERE role <> 'assistant' AND text <> ''), 0)::BIGINT AS prompt_tokens,
  coalesce(sum(greatest(1, length(text) // 4)) FILTER (WHERE role = 'assistant' AND text <> ''), 0)::BIGINT AS completion_tokens FROM conversations GROUP BY conv_id""")
def usage_totals(spark, d):
    said, n = F.col("role") == "assistant", T.count_tokens(F.col("text"))
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.when(said, 1)).alias("calls"), total(~said).alias("prompt_tokens"), total(said).alias("completion_tokens"))


# The default provider keeps the first words of each block; one of ten doubles its text instead, as a bad reply would.
_OUT = f"""WITH {CHUNKS}, o AS (SELECT *, array_to_string(list_slice(string_split(text, ' '), 1, greatest(1, round_even({RATIO}::DOUBLE * len(string_split(text, ' ')), 0)::BIGINT)), ' ') AS out FROM greedy),
  t AS (SELECT *, CASE WHEN out = '' THEN 0 ELSE greatest(1, length(out) // 4) END AS out_tokens FROM o)"""


def _condensed(spark, d):
    g = B.chunked(docs(spark, d), CHUNK).withColumn("out", C.extract(F.col("text"), RATIO))
    return g.withColumn("out_tokens", T.count_tokens(F.col("out")))


@query(f"{_OUT} SELECT chapter, block_index, out FROM t")
def extractive_condense(spark, d):
    return _condensed(spark, d).select("chapter", "block_index", "out")


@query(f"{_OUT} SELECT book, sum(tokens)::BIGINT AS input_tokens, sum(out_tokens)::BIGINT AS output_tokens, sum(out_tokens)::DOUBLE / sum(tokens)::DOUBLE AS kept_ratio FROM t GROUP BY book")
def condense_ratio_report(spark, d):
    g = _condensed(spark, d).groupBy("book").agg(F.sum("tokens").alias("input_tokens"), F.sum("out_tokens").alias("output_tokens"))
    return g.withColumn("kept_ratio", F.col("output_tokens").cast("double") / F.col("input_tokens").cast("double"))


@query(f"""{_OUT} SELECT chapter, chunk_no, sum(CASE WHEN chapter % 10 = 0 THEN greatest(1, (2 * length(text) + 1) // 4) ELSE out_tokens END) > sum(tokens) AS over_length FROM t GROUP BY chapter, chunk_no""")
def over_length_flags(spark, d):
    """A chunk is over length when what came back has more tokens than its source; one chapter of ten is said twice."""
    twice = T.count_tokens(F.concat_ws(" ", "text", "text"))
    said = _condensed(spark, d).withColumn("out_tokens", F.when(F.col("chapter") % 10 == 0, twice).otherwise(F.col("out_tokens")))
    return said.groupBy("chapter", "chunk_no").agg((F.sum("out_tokens") > F.sum("tokens")).alias("over_length"))


@query(f"{_OUT}, r AS (SELECT book, sum(out_tokens)::DOUBLE / sum(tokens)::DOUBLE AS kept_ratio FROM t GROUP BY book) SELECT book, kept_ratio FROM r WHERE kept_ratio > 0 AND kept_ratio < 0.5::DOUBLE * 0.75::DOUBLE")
def undershoot_warnings(spark, d):
    return C.undershoots(condense_ratio_report(spark, d), 0.5).select("book", "kept_ratio")


_SYN = f"""{_OUT}, c AS (SELECT chapter, sum(tokens)::BIGINT AS n, sum(out_tokens)::BIGINT AS o, max(chunk_no) AS chunks, greatest(round_even(0.2::DOUBLE * sum(tokens), 0)::BIGINT, 100) AS target FROM t GROUP BY chapter),
  p AS (SELECT *, NOT (chunks = 1 AND o <= target) AS smoothed FROM c), q AS (SELECT *, CASE WHEN smoothed THEN round_even(o * 0.9::DOUBLE, 0)::BIGINT ELSE o END AS s FROM p),
  z AS (SELECT *, (smoothed AND s > target * 1.15::DOUBLE)::INT AS trim_passes FROM q)"""


@query(f"{_SYN} SELECT chapter, n AS input_tokens, target AS target_tokens, CASE WHEN trim_passes = 1 THEN round_even(s * 0.94::DOUBLE, 0)::BIGINT ELSE s END AS output_tokens, smoothed FROM z")
def synthesize_chapters(spark, d):
    return C.synthesize(_condensed(spark, d), 0.2).select("chapter", "input_tokens", "target_tokens", "output_tokens", "smoothed")


@query(f"{_SYN} SELECT trim_passes, count(*) AS chapters FROM z GROUP BY trim_passes")
def trim_pass_counts(spark, d):
    return C.synthesize(_condensed(spark, d), 0.2).groupBy("trim_passes").agg(F.count("*").alias("chapters"))


@query(r"""SELECT doc_id, pos - 1 AS pos, p AS paragraph FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\n\s*\n'), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '') AS ps FROM documents))""")
def split_paragraphs(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.split_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n \n")))).alias("pos", "paragraph")).withColumn("pos", F.col("pos").cast("long"))


_LANGS = ("Spanish", "es-MX", "ES_mx", "german", "Klingon", "fr", " Spanish (Latin America)", "", "zh-Hant", "x")


_TAGS = ("es", "es-MX", "es-mx", "de", "und", "fr", "es", "und", "zh-Hant", "und")


@query("WITH m(n, lang, tag) AS (VALUES " + ", ".join(f"({n}, '{a}', '{b}')" for n, (a, b) in enumerate(zip(_LANGS, _TAGS))) + """)
  SELECT doc_id, coalesce(m.lang, d.lang) AS lang, coalesce(tag, d.lang, 'und') AS tag FROM documents d LEFT JOIN m ON m.n = d.doc_id % 12""")
def bcp47_lang(spark, d):
    """Languages as documents may name them: a name or code by their number, else their own code."""
    n = (F.col("doc_id") % 12).cast("int")
    lang = F.when(n < len(_LANGS), F.get(F.array(*map(F.lit, _LANGS)), n)).otherwise(F.col("lang"))
    return docs(spark, d).select("doc_id", lang.alias("lang")).select("doc_id", "lang", T.to_bcp47(F.col("lang")).alias("tag"))


# Each document is a book of pages of 10 lines, whose every 25th line from the fourth is an entry of its contents.
_TOC = f"""WITH {LINES}, toc AS (SELECT chapter AS doc, (block_index // 25)::INT AS ord, text AS title, (block_index // 10)::INT AS start_page FROM lines WHERE block_index % 25 = 3),
  t AS (SELECT *, lead(start_page) OVER (PARTITION BY doc ORDER BY start_page, ord) AS end_page FROM toc), pages AS (SELECT DISTINCT chapter AS doc, (block_index // 10)::INT AS page FROM lines)"""


def _contents(spark, d):
    lines = B.paragraphs(docs(spark, d)).withColumnRenamed("chapter", "doc")
    page = F.floor(F.col("block_index") / 10).cast("int")
    toc = lines.where("block_index % 25 = 3").select("doc", F.floor(F.col("block_index") / 25).cast("int").alias("ord"), F.col("text").alias("title"), page.alias("start_page"))
    return lines.select("doc", page.alias("page")).distinct(), toc


@query(f"{_TOC} SELECT pages.doc, page, ord, title FROM pages JOIN t ON pages.doc = t.doc AND page >= start_page AND (end_page IS NULL OR page < end_page)")
def toc_chapters(spark, d):
    return B.pages_to_chapters(*_contents(spark, d))


@query(f"""{_TOC} SELECT pages.doc, page, ord, title FROM pages JOIN t ON pages.doc = t.doc AND page >= start_page AND (end_page IS NULL OR page < end_page)
  UNION ALL SELECT doc, page, 0, 'Book ' || doc FROM pages WHERE doc NOT IN (SELECT doc FROM toc)""")
def pdf_chapters(spark, d):
    """Books without an entry are one chapter under their own title."""
    pages, toc = _contents(spark, d)
    titles = docs(spark, d).select(F.col("doc_id").alias("doc"), F.concat(F.lit("Book "), F.col("doc_id").cast("string")).alias("title"))
    return PDF.chapters(pages, toc, titles, B.pages_to_chapters)


@query(f"""{_TOC}, given AS (SELECT doc, 0 AS ord, 'given' AS title, 1 AS start_page FROM (SELECT DISTINCT doc FROM pages) WHERE doc % 4 = 0), inferred AS (SELECT doc, 0 AS ord, 'inferred' AS title, 0 AS start_page FROM (SELECT DISTINCT doc FROM pages))
  SELECT * FROM given UNION ALL SELECT * FROM toc WHERE doc % 4 <> 0 UNION ALL SELECT * FROM inferred WHERE doc % 4 <> 0 AND doc NOT IN (SELECT doc FROM toc)""")
def toc_precedence(spark, d):
    """Contents given by hand come first, then the outline, then what was inferred."""
    pages, outline = _contents(spark, d)
    every = pages.select("doc").distinct()
    one = lambda title, start: (F.lit(0).alias("ord"), F.lit(title).alias("title"), F.lit(start).alias("start_page"))
    return PDF.chosen_toc(every.where("doc % 4 = 0").select("doc", *one("given", 1)), outline, every.select("doc", *one("inferred", 0)))


class _Reader:
    """Answers a question about contents with each page whose text begins with an even number of letters, torn entries among them."""

    def generate(self, system, user):
        import json
        import re

        found = [{"title": f"p{k}", "start_page": k} for k, text in re.findall(r"(?ms)^\[PAGE (\d+)\]\n(.*?)(?=\n\n\[PAGE|\Z)", user) if len(text) % 2 == 0]
        return f"```json\n{json.dumps({'chapters': [*found, {'title': 'torn'}, {'title': 'x', 'start_page': 'none'}]})}\n```"


@query(f"""WITH {LINES}, p AS (SELECT chapter AS doc, block_index // 10 AS page, string_agg(text, chr(10) ORDER BY block_index) AS text FROM lines GROUP BY 1, 2)
  SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY page) - 1)::INT AS ord, 'p' || page AS title, page::INT AS start_page FROM p WHERE page < 20 AND length(text) % 2 = 0""")
def toc_inference(spark, d):
    """A provider reads the first twenty pages of each book."""
    lines = B.paragraphs(docs(spark, d)).select(F.col("chapter").alias("doc"), F.floor(F.col("block_index") / 10).cast("int").alias("page"), F.col("block_index").alias("line_no"), "text")
    return PDF.inferred_toc(PDF.toc_samples(PDF.page_texts(lines)), _Reader())


# Lines of a laid-out page: 40 a page, 12 high, every seventh after a gap, some large or in a code font.
_PDF = f"""WITH {LINES}, pdf AS (SELECT chapter AS doc, block_index // 40 AS page, block_index AS line_no, (block_index % 40) * 14 + (block_index % 40) // 7 * 20 AS top, (block_index % 40) * 14 + (block_index % 40) // 7 * 20 + 12 AS bottom,
  text, CASE WHEN block_index % 11 = 4 THEN 'Courier' ELSE 'Times' END AS font, (CASE WHEN block_index % 13 = 0 THEN 18 WHEN block_index % 17 = 5 THEN 14 ELSE 10 END)::DOUBLE AS size FROM lines)"""


def _pdf(spark, d):
    i = F.col("block_index")
    top = (i % 40) * 14 + F.floor((i % 40) / 7).cast("int") * 20
    return B.paragraphs(docs(spark, d)).select(
        F.col("chapter").alias("doc"), F.floor(i / 40).cast("int").alias("page"), i.alias("line_no"), top.alias("top"), (top + 12).alias("bottom"), "text",
        F.when(i % 11 == 4, "Courier").otherwise("Times").alias("font"), F.when(i % 13 == 0, 18.0).when(i % 17 == 5, 14.0).otherwise(10.0).alias("size"),
    )


@query(f"{_PDF} SELECT doc, page, line_no FROM pdf WHERE NOT EXISTS (SELECT 1 FROM (VALUES (0, 30, 90), (1, 200, 260)) t(page, top, bottom) WHERE t.page = pdf.page AND (pdf.top + pdf.bottom) / 2 BETWEEN t.top AND t.bottom)")
def table_line_exclusion(spark, d):
    lines = _pdf(spark, d)
    area = lambda page, top, bottom: F.struct(F.lit(page).alias("page"), F.lit(top).alias("top"), F.lit(bottom).alias("bottom"))
    tables = lines.select("doc").distinct().select("doc", F.inline(F.array(area(0, 30, 90), area(1, 200, 260))))
    return B.outside_tables(lines, tables).select("doc", "page", "line_no")


_KIND = f"""{_PDF}, b AS (SELECT doc, coalesce(median(size) FILTER (WHERE font <> 'Courier'), 11) AS body FROM pdf GROUP BY doc),
  k AS (SELECT pdf.*, body, CASE WHEN font = 'Courier' THEN 'code' WHEN size >= 1.25 * body THEN 'heading' ELSE 'body' END AS kind FROM pdf JOIN b USING (doc))"""


@query(f"{_KIND} SELECT doc, page, line_no, kind FROM k")
def pdf_line_classify(spark, d):
    return B.classify_lines(_pdf(spark, d)).select("doc", "page", "line_no", "kind")


@query(f"""{_KIND}, f AS (SELECT *, (kind = 'heading' OR lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind OR (kind = 'body' AND top - lag(bottom) OVER w > 0.6 * 12))::INT AS new FROM k WINDOW w AS (PARTITION BY doc, page ORDER BY top, line_no)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY top, line_no)::INT AS island FROM f)
  SELECT doc, page, island, CASE WHEN any_value(kind) = 'body' THEN 'paragraph' ELSE any_value(kind) END AS type, CASE WHEN any_value(kind) = 'heading' THEN CASE WHEN max(size / body) >= 1.6 THEN 1 ELSE 2 END ELSE 0 END AS level,
  CASE WHEN any_value(kind) = 'code' THEN string_agg(text, chr(10) ORDER BY top, line_no) ELSE string_agg(text, ' ' ORDER BY top, line_no) END AS text FROM g GROUP BY doc, page, island""")
def pdf_blocks(spark, d):
    return B.line_blocks(B.classify_lines(_pdf(spark, d))).drop("top").withColumn("level", F.coalesce("level", F.lit(0)))


@query("""SELECT doc, doc_id AS chapter, 'pdfimg-' || left(h, 16) AS image_id FROM (SELECT source AS doc, doc_id, sha256(text) AS h FROM documents) QUALIFY row_number() OVER (PARTITION BY doc, h ORDER BY doc_id) = 1""")
def asset_dedupe(spark, d):
    x = docs(spark, d).select(F.col("source").alias("doc"), F.col("doc_id").alias("chapter"), F.lit(0).alias("page"), F.lit(0).alias("pos"), F.col("text").cast("binary").alias("data"))
    return B.first_of_content(x).select("doc", "chapter", "image_id")


@query("SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ' ' || chr(10)) AS title FROM pages")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))


@query()
def page_blocks(spark, d):
    return H.blocks(table(spark, d, "pages"), "page_id", "html")


@query()
def page_list_items(spark, d):
    return H.blocks(table(spark, d, "pages"), "page_id", "html").where("type = 'list'").select("page_id", "block_index", F.posexplode("items").alias("pos", "item"))


@query()
def sanitize_inline(spark, d):
    return table(spark, d, "pages").select("page_id", H.sanitize("html").alias("rich"))


@query()
def strip_tags(spark, d):
    return sanitize_inline(spark, d).select("page_id", H.strip_tags("rich").alias("text"))


@query()
def tag_signature(spark, d):
    return sanitize_inline(spark, d).select("page_id", H.tag_signature(F.col("rich")).alias("tags"))


@query(f"{_TYPED}, m AS (SELECT *, CASE type WHEN 'heading' THEN '## ' || text WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```' WHEN 'quote' THEN '> ' || text WHEN 'image' THEN '![' || text || '](images/' || block_index || '.png)' ELSE text END AS md FROM typed) SELECT chapter, string_agg(md, chr(10) || chr(10) ORDER BY block_index) || chr(10) AS markdown FROM m GROUP BY chapter")
def markdown_render(spark, d):
    return RD.to_markdown(_renderable(spark, d), ["chapter"])


def _esc(x: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw if raw != chr(39) * 2 else chr(39) * 2}', '{entity}')"
    return x


@query(f"""{_TYPED}, m AS (SELECT *, CASE type WHEN 'heading' THEN '<h2>' || e || '</h2>' WHEN 'code' THEN '<pre><code>' || e || '</code></pre>' WHEN 'quote' THEN '<blockquote>' || e || '</blockquote>'
  WHEN 'image' THEN '<figure><img src="images/' || block_index || '.png" alt="' || e || '"/><figcaption>' || e || '</figcaption></figure>' ELSE '<p>' || e || '</p>' END AS h FROM (SELECT *, {_esc('text')} AS e FROM typed)) SELECT chapter, string_agg(h, chr(10) ORDER BY block_index) AS html FROM m GROUP BY chapter""")
def html_render(spark, d):
    return RD.to_html(_renderable(spark, d), ["chapter"])


def _renderable(spark, d):
    image = F.col("type") == "image"
    t = typed(spark, d).withColumn("caption", F.when(image, F.col("text"))).withColumn("link", F.when(image, F.concat(F.lit("images/"), F.col("block_index").cast("string"), F.lit(".png"))))
    return t.withColumns({"level": F.lit(2), "items": F.lit(None).cast("array<string>"), "rows": F.lit(None).cast("array<array<string>>"), "ordered": F.lit(False), "language": F.lit(None).cast("string")})


# Each document is a book of chapters of 20 lines; two lines of three are anchors a0 to a49, and each links to one of a0 to a59.
_ANCHOR = f"""WITH {LINES}, x AS (SELECT chapter AS doc, block_index, block_index // 20 + 1 AS chapter_no, CASE WHEN block_index % 3 > 0 THEN 'a' || (block_index % 50) END AS anchor_id, 'a' || (block_index * 7 % 60) AS target, text FROM lines),
  loc AS (SELECT doc, anchor_id, min(chapter_no)::INT AS chapter_no FROM x WHERE anchor_id IS NOT NULL GROUP BY doc, anchor_id)"""


def _linked(spark, d):
    i = F.col("block_index")
    x = B.paragraphs(docs(spark, d)).withColumnRenamed("chapter", "doc")
    name = lambda c: F.concat(F.lit("a"), c.cast("string"))
    rich = F.concat(F.lit('<a href="bbref:'), name(i * 7 % 60), F.lit('"><em>'), T.html_escape(F.col("text")), F.lit("</em></a>"))
    return x.select("doc", i, (F.floor(i / 20) + 1).cast("int").alias("chapter_no"), F.lit("paragraph").alias("type"), F.when(i % 3 > 0, name(i % 50)).alias("anchor_id"), rich.alias("rich"), F.lit(None).cast("array<string>").alias("items_rich"))


@query(f"{_ANCHOR} SELECT * FROM loc")
def anchor_locations(spark, d):
    return L.anchor_locations(_linked(spark, d), ["doc"])


@query(f"""{_ANCHOR} SELECT x.doc, x.block_index, CASE WHEN loc.chapter_no IS NULL THEN '' WHEN loc.chapter_no = x.chapter_no THEN '<a href="#' || x.target || '">' ELSE '<a href="chap-' || loc.chapter_no || '.xhtml#' || x.target || '">' END
  || '<em>' || {_esc('x.text')} || '</em>' || CASE WHEN loc.chapter_no IS NULL THEN '' ELSE '</a>' END AS rich FROM x LEFT JOIN loc ON x.doc = loc.doc AND x.target = loc.anchor_id""")
def bbref_resolve(spark, d):
    x = _linked(spark, d)
    return L.linked(x, ["doc"], L.anchor_locations(x, ["doc"])).select("doc", "block_index", "rich")


@query(f"""{_ANCHOR} SELECT x.doc, x.block_index, CASE WHEN loc.chapter_no IS NULL THEN '' ELSE '<a href="#' || x.target || '">' END || '<em>' || {_esc('x.text')} || '</em>' || CASE WHEN loc.chapter_no IS NULL THEN '' ELSE '</a>' END AS rich
  FROM x LEFT JOIN loc ON x.doc = loc.doc AND x.target = loc.anchor_id""")
def bbref_one_file(spark, d):
    x = _linked(spark, d)
    return L.linked(x, ["doc"], L.anchor_locations(x, ["doc"]), one_file=True).select("doc", "block_index", "rich")


# Each run's reply names its blocks and wraps their text; every fifth chapter's reply is torn, so it keeps its blocks.
@query(f"""{_TYPED}, n AS (SELECT *, row_number() OVER (PARTITION BY chapter, run_id ORDER BY block_index) AS k FROM runs WHERE run_id IS NOT NULL)
  SELECT chapter, run_id, chapter % 5 = 0 AS degraded, (k - 1)::INT AS pos, k::INT AS source, type, CASE WHEN chapter % 5 = 0 THEN text ELSE '~' || text || '~' END AS text FROM n""")
def addressed_replies(spark, d):
    r = B.runs(typed(spark, d), ["chapter"]).withColumn("items", F.lit(None).cast("array<string>"))
    k = F.row_number().over(W.partitionBy("chapter", "run_id").orderBy("block_index"))
    entry = r.where("run_id is not null").withColumn("e", F.struct(k.alias("block"), "type", F.concat(F.lit("~"), "text", F.lit("~")).alias("text")))
    reply = F.to_json(F.array_sort(F.collect_list("e")))
    said = entry.groupBy("chapter", "run_id").agg(F.when(F.col("chapter") % 5 == 0, F.concat(reply, F.lit("["))).otherwise(reply).alias("reply"))
    return R.apply_replies(r, said, ["chapter"]).select("chapter", "run_id", "degraded", "pos", "source", "type", "text")


# Fixed cases of the reply table: kinds of the run, reply, whether it degrades, texts of the result.
_REPLIES = [
    ("string", "paragraph", '"a\\n\\nb"', False, "a|b"), ("string for a list", "list", '"a"', True, "own"), ("empty string", "paragraph", '""', False, ""),
    ("merged", "paragraph,paragraph", '[{"block": 2, "text": "m"}]', False, "m"), ("split", "paragraph", '[{"block": 1, "text": "a"}, {"block": "1", "text": "b"}]', False, "a|b"),
    ("descending", "paragraph,paragraph", '[{"block": 2, "text": "a"}, {"block": 1, "text": "b"}]', True, "own|own"), ("list dropped", "paragraph,list", '[{"block": 1, "text": "a"}]', True, "own|own"),
    ("truth value", "paragraph", '[{"block": true, "text": "a"}]', False, "a"), ("unknown block", "paragraph", '[{"block": 3, "text": "a"}]', True, "own"),
    ("positional", "paragraph,quote", '["a", {"type": "quote", "text": "b"}]', False, "a|b"), ("other length", "paragraph,paragraph", '["a", "b", "c"]', False, "a|b|c"),
    ("other length with quote", "paragraph,quote", '["a"]', True, "own|own"), ("wrong type", "paragraph", '[{"block": 1, "type": "list", "text": "a"}]', True, "own"), ("missing", "paragraph", None, True, "own"), ("no text", "paragraph", '[{"block": 1, "text": " "}]', True, "own"),
    ("empty array", "paragraph", "[]", False, ""),
]


_CASES = "WITH v(n, name, degraded, texts) AS (VALUES " + ", ".join(f"({i}, '{n}', {str(deg).lower()}, '{t}')" for i, (n, _, _, deg, t) in enumerate(_REPLIES)) + ")"


@query(f"{_CASES} SELECT doc_id, name, degraded, replace(texts, 'own', 'Chapter ' || doc_id) AS texts FROM documents JOIN v ON v.n = doc_id % {len(_REPLIES)}")
def reply_table(spark, d):
    """Each document's title as a run of blocks, with one of the cases for its reply."""
    pick = lambda held: F.get(F.array(*(F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x) for x in held)), F.col("n"))
    cases = docs(spark, d).select("doc_id", title().alias("own"), (F.col("doc_id") % len(_REPLIES)).cast("int").alias("n"))
    cases = cases.select("doc_id", "own", pick([c[0] for c in _REPLIES]).alias("name"), pick([c[1].split(",") for c in _REPLIES]).alias("kinds"), pick([c[2] for c in _REPLIES]).alias("reply"))
    own = F.transform("kinds", lambda x: F.struct(x.alias("type"), F.col("own").alias("text"), F.array("own").alias("items")))
    read = cases.select("doc_id", "name", R.rebuilt(own, F.col("reply")).alias("r"))
    return read.select("doc_id", "name", "r.degraded", F.array_join(F.transform("r.pieces", lambda p: p["text"]), "|").alias("texts"))


@query(f"""{_TYPED}, n AS (SELECT *, row_number() OVER (PARTITION BY chapter, run_id ORDER BY block_index) AS k, lag(run_id) OVER (PARTITION BY chapter ORDER BY block_index) AS before FROM runs),
  m AS (SELECT *, CASE kind WHEN 'text' THEN CASE WHEN before IS DISTINCT FROM run_id THEN chr(10) || '[TEXT ' || run_id || ']' || chr(10) ELSE '' END || '[BLOCK ' || k || ' type=' || type || ']' || chr(10) || text
    WHEN 'image' THEN chr(10) || '[IMG:i' || block_index || ' — "fig"]' ELSE chr(10) || CASE type WHEN 'heading' THEN '[HEADING] ## ' || text ELSE '[CODE BLOCK - preserved verbatim, do not reproduce]' || chr(10) || '```' || chr(10) || rtrim(text, ' ') || chr(10) || '```' END END AS line FROM n)
  SELECT chapter, trim(string_agg(line, chr(10) ORDER BY block_index), ' ' || chr(10)) AS body FROM m GROUP BY chapter""")
def prompt_bodies(spark, d):
    r = B.runs(typed(spark, d), ["chapter"]).withColumns({"level": F.lit(2), "language": F.lit(None).cast("string"), "image_id": F.concat(F.lit("i"), F.col("block_index").cast("string")), "caption": F.lit("fig")})
    return P.bodies(r, ["chapter"])


@query("""SELECT p_brand AS brand, coalesce(string_agg('- ' || p_name || ' ' || p_partkey || ' → ' || p_type, chr(10) ORDER BY p_partkey) FILTER (WHERE p_partkey % 7 > 0), '') AS lines FROM part GROUP BY p_brand""")
def glossary_prompt(spark, d):
    """A glossary for each brand, of its parts and their types; some have no target and fall away."""
    named = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    one = F.struct("p_partkey", F.struct(named.alias("k"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_type")).otherwise(" ").alias("v")).alias("e"))
    held = table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_list(one)).alias("t"))
    terms = F.to_json(F.map_from_entries(F.transform("t", lambda x: x["e"])))
    return held.select("brand", P.glossary_lines(P.glossary(terms)).alias("lines"))


_USAGE = "u AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS model, coalesce(sum(length(text)) FILTER (WHERE role <> 'assistant'), 0)::BIGINT AS prompt_tokens, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS completion_tokens FROM conversations GROUP BY conv_id)"


@query(f"WITH {_USAGE} SELECT conv_id, model, CASE WHEN model = 'a' AND prompt_tokens * 0.5::DOUBLE + completion_tokens * 2::DOUBLE > 0 THEN prompt_tokens * 0.5::DOUBLE + completion_tokens * 2::DOUBLE END AS cost FROM u")
def usage_cost(spark, d):
    n = F.length("text").cast("long")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    said, by = F.col("role") == "assistant", F.col("conv_id") % 3
    u = table(spark, d, "conversations").groupBy("conv_id", F.when(by == 0, "a").when(by == 1, "b").otherwise("c").alias("model")).agg(total(~said).alias("prompt_tokens"), total(said).alias("completion_tokens"))
    return P.costs(u, spark.createDataFrame([("a", 0.5, 2.0), ("b", 0.0, 0.0)], "model string, prompt_price double, completion_price double")).select("conv_id", "model", "cost")


def _units(spark, d):
    x = docs(spark, d)
    return X.units_of(x.select(F.col("doc_id").alias("chapter"), title().alias("title")), B.paragraphs(x).withColumn("items", F.lit(None).cast("array<string>")), ["chapter"])


_UNITS = f"""WITH {LINES}, u AS (SELECT chapter, row_number() OVER (PARTITION BY chapter ORDER BY block_index) - 1 AS unit, text FROM
  (SELECT chapter, block_index, text FROM lines UNION ALL SELECT doc_id, -1, 'Chapter ' || doc_id FROM documents))"""


@query(f"{_UNITS} SELECT chapter, unit::INT AS unit, (unit // 40 * 40)::INT AS batch_start, text FROM u")
def translatable_units(spark, d):
    return B.unit_batches(_units(spark, d), ["chapter"], "place").select("chapter", "unit", "batch_start", "text")


def _echo(batch: dict[str, str]) -> str:
    """A provider that marks each text, and whose reply is torn when a text's length is a multiple of 29."""
    import json

    said = json.dumps({"translations": {i: "» " + t for i, t in batch.items()}})
    return said[:-2] + "," if any(len(t) % 29 == 0 for t in batch.values()) else f"```json\n{said}\n```"


def _translated(spark, d):
    return X.translate_units(_units(spark, d), ["chapter"], "place", _echo)


@query(f"{_UNITS} SELECT chapter, unit::INT AS unit, (unit // 40 * 40)::INT AS batch_start, length(text) % 29 > 0 AS translated, CASE WHEN length(text) % 29 = 0 THEN text ELSE '» ' || text END AS text FROM u")
def translate_chapters(spark, d):
    return _translated(spark, d)


@query(f"{_UNITS} SELECT chapter, (unit // 40 * 40)::INT AS batch_start, count(*) AS units FROM u GROUP BY ALL HAVING bool_and(length(text) % 29 > 0)")
def translate_cacheable(spark, d):
    return X.complete_batches(_translated(spark, d), ["chapter"])


@query()
def tag_faithful_rewrite(spark, d):
    """The reply loses its emphasis on odd pages."""
    said = sanitize_inline(spark, d).withColumn("reply", F.when(F.col("page_id") % 2 == 1, F.regexp_replace("rich", "</?(strong|em)>", "")).otherwise(F.col("rich")))
    return said.select("page_id", X.faithful(F.col("rich"), F.col("reply")).alias("f")).select("page_id", "f.*")


# Each document is a book of chapters of 20 lines, written as an archive and read again.
@query(f"""WITH {LINES} SELECT chapter AS doc_id, block_index // 20 AS chapter, (block_index % 20)::INT AS block_index, 'paragraph' AS type, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ') AS text FROM lines""")
def epub_round_trip(spark, d):
    lines = T.lines_of(F.col("text"))
    paragraph = lambda x: F.concat(F.lit("<p>"), T.html_escape(x), F.lit("</p>"))
    whole = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 20).cast("int")), lambda i: F.struct(F.lit(None).cast("string").alias("title"), F.array_join(F.transform(F.slice("l", i * 20 + 1, F.lit(20)), paragraph), "\n").alias("html")))
    books = docs(spark, d).select("doc_id", F.concat(F.lit("Book "), F.col("doc_id").cast("string")).alias("title"), F.col("lang").alias("language"), lines.alias("l")).where("size(l) > 0").withColumn("chapters", whole)
    return E.read_blocks(E.write_books(books, "doc_id"), "doc_id").select("doc_id", "chapter", "block_index", "type", "text")


# Typed lines as blocks with all columns; images go by a name, of which some have no asset.
def _blocks(spark, d):
    t = typed(spark, d).withColumn("image_id", F.when(F.col("type") == "image", F.concat(F.lit("i"), (F.col("block_index") % 50).cast("string"))))
    image = F.col("type") == "image"
    return t.select("chapter", "block_index", "type", F.when(~image, F.col("text")).alias("text"), F.when(image, F.col("text")).alias("caption"), "image_id", F.when(F.col("type") == "heading", 2).alias("level"))


_SAID = "array_to_string(list_slice(w, 1, greatest(1, round_even(0.3::DOUBLE * len(w), 0)::BIGINT)), ' ')"
_BLOCKCHUNKS = f"""WITH RECURSIVE {LINES}, typed AS (SELECT chapter, block_index, text, tokens, CASE WHEN block_index % 7 = 0 THEN 'heading' WHEN block_index % 7 = 3 THEN 'code' WHEN block_index % 7 = 5 THEN 'image' WHEN block_index % 7 = 6 THEN 'quote' ELSE 'paragraph' END AS type FROM lines),
  greedy AS (SELECT chapter, block_index, text, type, tokens, tokens AS held, 1 AS chunk_no FROM typed WHERE block_index = 0 UNION ALL SELECT l.chapter, l.block_index, l.text, l.type, l.tokens,
    CASE WHEN g.held + l.tokens > {CHUNK} THEN l.tokens ELSE g.held + l.tokens END, CASE WHEN g.held + l.tokens > {CHUNK} THEN g.chunk_no + 1 ELSE g.chunk_no END FROM greedy g JOIN typed l ON l.chapter = g.chapter AND l.block_index = g.block_index + 1),
  words AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w, type IN ('paragraph', 'quote') AS prose FROM greedy),
  said AS (SELECT chapter, chunk_no, block_index, type, tokens, CASE WHEN prose THEN {_SAID} ELSE text END AS text FROM words)"""


def _chunk_rows(spark, d):
    return S.chunk_rows(_blocks(spark, d), ["chapter"], CHUNK)


@query(f"""{_BLOCKCHUNKS} SELECT chapter, chunk_no, (row_number() OVER (PARTITION BY chapter, chunk_no ORDER BY block_index) - 1)::INT AS pos, type, text FROM said""")
def condense_chunks(spark, d):
    """Every chunk through the provider: prompts, replies by block, images that the reply names."""
    keys = ["chapter", "chunk_no"]
    done = S.condense(_chunk_rows(spark, d), keys, PR.Extracting())
    flat = done.select(*keys, F.posexplode("blocks").alias("pos", "b"))
    return flat.select(*keys, "pos", "b.type", F.coalesce("b.text", "b.caption").alias("text"))


@query(f"""{_BLOCKCHUNKS}, o AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS out FROM said) SELECT chapter, chunk_no, sum(tokens)::BIGINT AS input_tokens, sum(out)::BIGINT AS output_tokens, sum(out) > sum(tokens) AS over_length, false AS failed FROM o GROUP BY chapter, chunk_no""")
def condense_sizes(spark, d):
    done = S.condense(_chunk_rows(spark, d), ["chapter", "chunk_no"], PR.Extracting())
    return done.select("chapter", "chunk_no", "input_tokens", "output_tokens", "over_length", "failed")


class _Torn:
    """Leaves out the first run of a prompt, so that it keeps its wording."""

    def generate(self, system, user):
        import json

        said = json.loads(PR.Extracting().generate(system, user))
        said["texts"].pop("1", None)
        return json.dumps(said)


@query(f"""{_BLOCKCHUNKS}, s AS (SELECT *, prose AND NOT coalesce(lag(prose) OVER (PARTITION BY chapter, chunk_no ORDER BY block_index), false) AS st FROM words), n AS (SELECT chapter, chunk_no, sum(st::INT) AS runs FROM s GROUP BY chapter, chunk_no)
  SELECT chapter, chunk_no, CASE WHEN runs > 1 THEN 1 ELSE 0 END AS degraded, runs = 1 AS failed FROM n""")
def degraded_runs(spark, d):
    """A chunk whose only run can't be read fails; one of several just keeps its wording."""
    done = S.condense(_chunk_rows(spark, d), ["chapter", "chunk_no"], _Torn())
    return done.select("chapter", "chunk_no", "degraded", "failed")


@query(f"""{_BLOCKCHUNKS}, s AS (SELECT *, prose AND NOT coalesce(lag(prose) OVER (PARTITION BY chapter, chunk_no ORDER BY block_index), false) AS st FROM words), n AS (SELECT chapter, chunk_no, sum(st::INT) AS runs FROM s GROUP BY chapter, chunk_no)
  SELECT count_if(runs > 1)::BIGINT AS degraded, CASE WHEN count_if(runs > 1) > 0 THEN count_if(runs > 1) || ' passages kept their wording: the reply for them didn''t have the expected form' END AS warning FROM n""")
def degraded_totals(spark, d):
    done = S.condense(_chunk_rows(spark, d), ["chapter", "chunk_no"], _Torn())
    return S.degraded_total(done, done.where("false"))


@query(f"""{_BLOCKCHUNKS} SELECT 'condense' AS phase, count(DISTINCT (chapter, chunk_no))::BIGINT AS total, (count(DISTINCT (chapter, chunk_no)) FILTER (WHERE chapter % 2 = 0 AND chapter % 4 <> 0))::BIGINT AS reused FROM greedy""")
def reuse_counters(spark, d):
    """Of an earlier run's results for even chapters, those of every fourth have another fingerprint."""
    keys = ["chapter", "chunk_no"]
    wanted = _chunk_rows(spark, d).withColumn("fingerprint", S.chunk_fingerprint("", 0.3))
    run = lambda rows: S.condense(rows, keys, PR.Extracting())
    log = S.resumed(wanted.where("chapter % 2 = 0"), None, keys, S.CONDENSED, run)[1]
    log = log.withColumn("fingerprint", F.when(F.col("chapter") % 4 == 0, "old").otherwise(F.col("fingerprint")))
    return S.reuse_counters({"condense": S.resumed(wanted, log, keys, S.CONDENSED, run)[0]})


@query(f"""{_BLOCKCHUNKS}, o AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS out FROM said), c AS (SELECT chapter, sum(tokens)::BIGINT AS n, sum(out)::BIGINT AS o, max(chunk_no) AS chunks, bool_or(type IN ('paragraph', 'quote')) AS prose FROM o GROUP BY chapter)
  SELECT chapter, n AS input_tokens, greatest(round_even(n * 0.3::DOUBLE, 0)::BIGINT, 100) AS target_tokens, prose AND NOT (chunks = 1 AND o <= greatest(round_even(n * 0.3::DOUBLE, 0)::BIGINT, 100)) AS smoothed FROM c""")
def synthesis_plan(spark, d):
    """Which chapters the provider smooths, after really condensing them."""
    done = S.condense(_chunk_rows(spark, d), ["chapter", "chunk_no"], PR.Extracting())
    return S.synthesize(S.chapters_of(done, ["chapter"]), ["chapter"], PR.Extracting()).select("chapter", "input_tokens", "target_tokens", "smoothed")


_SHOWN = f"""{_TYPED}, i AS (SELECT chapter, block_index, 'i' || (block_index % 50) AS image_id, text FROM typed WHERE type = 'image'), assets AS (SELECT DISTINCT chapter, 'i' || k AS image_id FROM typed, range(0, 50, 2) r(k))"""


def _assets(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("chapter")).where(F.size(T.lines_of(F.col("text"))) >= 0).select("chapter", F.explode(F.sequence(F.lit(0), F.lit(48), F.lit(2))).alias("k")).select("chapter", F.concat(F.lit("i"), F.col("k").cast("string")).alias("image_id"))


@query(f"{_SHOWN} SELECT chapter, count(*) AS rankable FROM i SEMI JOIN assets USING (chapter, image_id) GROUP BY chapter")
def rankable_images(spark, d):
    return V.rankable(_blocks(spark, d), _assets(spark, d), ["chapter"]).groupBy("chapter").agg(F.count("*").alias("rankable"))


@query(f"""WITH {LINES}, a AS (SELECT doc_id AS chapter, 'i' || k AS image_id FROM documents, range(0, 50, 2) r(k)), s AS (SELECT DISTINCT chapter, 'i' || (block_index % 50) AS image_id, true AS seen FROM lines WHERE block_index % 7 = 5 UNION SELECT doc_id, 'i48', true FROM documents)
  SELECT chapter, coalesce(string_agg(image_id, ' ' ORDER BY image_id) FILTER (WHERE seen), '') AS kept, coalesce(string_agg(image_id, ' ' ORDER BY image_id) FILTER (WHERE seen IS NULL), '') AS dropped FROM a LEFT JOIN s USING (chapter, image_id) GROUP BY chapter""")
def image_report(spark, d):
    """Images kept and dropped, sorted: shown by a block, inside a text, or as the cover (i48)."""
    books = docs(spark, d).select(F.col("doc_id").alias("chapter"), F.lit("i48").alias("cover"))
    b = _blocks(spark, d).withColumns({"rich": F.lit(None).cast("string"), "items_rich": F.lit(None).cast("array<string>")})
    # Every second image block shows its image inside a text instead.
    inside = (F.col("type") == "image") & (F.col("block_index") % 2 == 1)
    rich = F.concat(F.lit('x <img data-image-id="'), "image_id", F.lit('"/>'))
    b = b.withColumn("rich", F.when(inside, rich)).withColumn("type", F.when(inside, "paragraph").otherwise(F.col("type")))
    return V.select(b, _assets(spark, d), books, ["chapter"])[2].select("chapter", F.array_join("kept", " ").alias("kept"), F.array_join("dropped", " ").alias("dropped"))


@query(f"""{_TYPED}, n AS (SELECT chapter, block_index, type, text, last_value(CASE WHEN type IN ('heading', 'paragraph', 'quote') THEN text END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(CASE WHEN type IN ('heading', 'paragraph', 'quote') THEN text END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY block_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM typed)
  SELECT chapter, block_index, left(array_to_string(list_filter(['Current caption: ' || text, before, after], lambda x: coalesce(x, '') <> ''), chr(10)), 600) AS context FROM n WHERE type = 'image'""")
def vision_contexts(spark, d):
    return V.contexts(_blocks(spark, d), ["chapter"]).select("chapter", "block_index", "context")


class _Eye:
    """Scores an image by the length of its context; some replies are torn, some scores are words, some have no caption."""

    def generate_with_image(self, user, image, mime):
        n = len(user) - len(V.PROMPT)
        if n % 11 == 0:
            return '{"score": '
        return f'{{"score": {chr(34) + "x" + chr(34) if n % 7 == 0 else n % 10 / 10}, "essential": true, "caption": "{"" if n % 2 else f"c{n}"}"}}'


@query(f"""{_TYPED}, n AS (SELECT chapter, block_index, type, text, last_value(CASE WHEN type IN ('heading', 'paragraph', 'quote') THEN text END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(CASE WHEN type IN ('heading', 'paragraph', 'quote') THEN text END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY block_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM typed),
  c AS (SELECT chapter, block_index, text, length(left(array_to_string(list_filter(['Current caption: ' || text, before, after], lambda x: coalesce(x, '') <> ''), chr(10)), 600)) AS n FROM n WHERE type = 'image')
  SELECT chapter, block_index, CASE WHEN n % 11 <> 0 AND n % 2 = 0 THEN 'c' || n ELSE text END AS caption FROM c WHERE n % 11 = 0 OR (n % 7 <> 0 AND n % 10 >= 5)""")
def vision_rank(spark, d):
    """Images that a provider scores at a half or more stay, and so do those whose reply can't be read."""
    b = _blocks(spark, d)
    told = V.contexts(b, ["chapter"]).withColumns({"content": F.lit("x").cast("binary"), "mime": F.lit("image/png")})
    ranked = V.ranked(b, V.verdicts(told, ["chapter", "block_index"], _Eye()), ["chapter"])
    return ranked.where("type = 'image'").select("chapter", "block_index", "caption")


@query(f"{_UNITS}, b AS (SELECT chapter, (unit // 40 * 40)::INT AS batch_start, string_agg(unit || chr(0) || text || chr(0), '' ORDER BY unit::VARCHAR) AS body FROM u GROUP BY 1, 2) SELECT chapter, batch_start, sha1('batch 1' || chr(0) || 'Spanish' || chr(0) || body) AS fingerprint FROM b")
def translate_batch_prints(spark, d):
    """Over the language and the batch's units, sorted by their numbers as text."""
    units = B.unit_batches(_units(spark, d), ["chapter"], "place")
    return X.batch_fingerprints(units, ["chapter"], "Spanish")


@query(f"""WITH {LINES} SELECT d.doc_id AS doc, '# Book ' || d.doc_id || chr(10) || chr(10) || coalesce(string_agg(CASE WHEN block_index % 20 = 0 THEN CASE WHEN block_index % 40 = 0 THEN '## Part ' || (block_index // 20) || chr(10) || chr(10) || lines.text ELSE '### ' || lines.text END ELSE lines.text END, chr(10) || chr(10) ORDER BY block_index), '') || chr(10) AS markdown
  FROM documents d JOIN lines ON lines.chapter = d.doc_id GROUP BY d.doc_id""")
def book_markdown(spark, d):
    """Books of chapters of 20 lines; every second chapter opens with a heading, and so goes without its title."""
    i = F.col("block_index")
    lines = B.paragraphs(docs(spark, d)).select(F.col("chapter").alias("doc"), F.floor(i / 20).cast("int").alias("chapter"), i, F.when(i % 40 == 20, "heading").otherwise("paragraph").alias("type"), "text", F.when(i % 40 == 20, 3).alias("level"))
    b = S.whole(lines).withColumn("link", F.lit(None).cast("string"))
    titles = lines.select("doc", "chapter").distinct().withColumn("title", F.concat(F.lit("Part "), F.col("chapter").cast("string")))
    books = docs(spark, d).select(F.col("doc_id").alias("doc"), F.concat(F.lit("Book "), F.col("doc_id").cast("string")).alias("title"))
    return RD.book_markdown(b, titles, books, ["doc"])


@query(f"""WITH {LINES}, w AS (SELECT chapter AS doc, (block_index // 40)::INT AS page, block_index AS line_no, text, length(text) AS n, length(text) - length(replace(text, 'e', '')) AS e FROM lines)
  SELECT doc, page, line_no, CASE WHEN n = 0 THEN '' WHEN 2 * e > n THEN 'E' WHEN 2 * e = n THEN CASE WHEN left(text, 1) = 'e' THEN 'E' ELSE 'O' END ELSE 'O' END AS font, (CASE WHEN 2 * e > n THEN 9 WHEN 2 * e = n THEN 10 ELSE 11 END)::DOUBLE AS size FROM w""")
def pdf_fonts(spark, d):
    """The most frequent font of a line's characters, the first met among equals, and their median size; each e is in a font of its own."""
    import pickle

    def extract(data: bytes) -> PDF.Extracted:
        pages = pickle.loads(data)  # noqa: S301
        return PDF.Extracted(lines=[[(14.0 * k, 14.0 * k + 12, t, [("E", 9.0) if c == "e" else ("O", 11.0) for c in t]) for k, t in enumerate(page)] for page in pages])

    @F.pandas_udf("binary")
    def packed(lines):
        return lines.map(lambda held: pickle.dumps([list(held[k : k + 40]) for k in range(0, len(held), 40)]))

    books = docs(spark, d).select(F.col("doc_id").alias("doc"), packed(T.lines_of(F.col("text"))).alias("content"))
    lines = PDF.read_lines(books, extract)
    return lines.select("doc", "page", (F.col("page") * 40 + F.col("line_no")).alias("line_no"), "font", "size")
