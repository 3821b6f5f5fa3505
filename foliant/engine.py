"""Whole books: read, condense or translate, choose images, and write.

A book goes by its path (doc). All steps work on any number of books at once; nothing but reports comes to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from foliant.functions import cost
from foliant.functions.provider import Provider
from foliant.functions.text import block_text, count_tokens, image_filename, to_bcp47
from foliant.operators import blocks as B, condense as C, links as L, render as R, stages as S, translate as X, vision as V
from foliant.sources import epub as E, pdf as P
from foliant.sources.files import store
from foliant.streaming.log import Log
from foliant.workspace import Workspace

DOC, CHAPTER = ["doc"], ["doc", "chapter"]
SUFFIXES = (".epub", ".pdf")


@dataclass
class Books:
    """blocks (doc, chapter, block_index and the columns of a walk), titles (doc, chapter, title), images and about (doc, title, author, language, cover)."""

    blocks: DataFrame
    titles: DataFrame
    images: DataFrame
    about: DataFrame


@dataclass
class Outcome:
    books: Books
    phases: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[DataFrame] = field(default_factory=list)
    report: DataFrame | None = None
    written: dict[str, object] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)

    def usage(self) -> DataFrame | None:
        """(phase, doc, calls and their tokens) of all phases; what was reused took none."""
        return S.usage({n: df for n, df in self.phases.items() if "calls" in df.columns}, DOC)

    def reuse(self) -> DataFrame | None:
        """(phase, total, reused): chunks, chapters, batches and images."""
        out = None
        for name, df in self.phases.items():
            rows = X.batch_counters(df, CHAPTER) if name == "translate" else S.reuse_counters({name: df})
            out = rows if out is None else out.unionByName(rows)
        return out

    def warned(self) -> DataFrame | None:
        """(doc, warning) of all phases."""
        out = None
        for w in self.warnings:
            out = w if out is None else out.unionByName(w)
        return out


def suffix(path: str) -> str:
    """The format of a file by its name; others than EPUB and PDF are an error."""
    found = next((s for s in SUFFIXES if path.lower().endswith(s)), None)
    if found is None:
        raise ValueError(f"unsupported input: {path!r} (known are {' and '.join(SUFFIXES)})")
    return found


def read_epub(files: DataFrame) -> Books:
    """Books from rows (path, content)."""
    files = files.select(F.col("path").alias("doc"), "content")
    rows = E.read_blocks(files, "doc")
    titles = rows.select("doc", "chapter", F.col("chapter_title").alias("title")).distinct()
    return Books(rows.drop("chapter_title"), titles, E.read_images(files, "doc"), E.read_metadata(files, "doc").drop("chapters"))


def read_pdf(files: DataFrame, extract=None, manual_toc: DataFrame | None = None, provider: Provider | None = None, first_pages: int = P.PAGES) -> Books:
    """Books from rows (path, content): chapters by a table of contents given by hand, else the outline, else inferred."""
    extract = extract or P.extractor()
    files = files.select(F.col("path").alias("doc"), "content")
    about, lines, tables = P.read_metadata(files, extract), P.read_lines(files, extract), P.read_tables(files, extract)
    outline = about.select("doc", F.posexplode("outline").alias("ord", "e")).select("doc", "ord", "e.title", "e.start_page")
    toc = P.chosen_toc(*([] if manual_toc is None else [manual_toc]), outline)
    if provider is not None:
        known = toc.select("doc").distinct()
        samples = P.toc_samples(P.page_texts(lines), first_pages).join(known, "doc", "left_anti")
        toc = P.chosen_toc(toc, P.inferred_toc(samples, provider))
    whole = B.page_blocks(lines, tables)
    pages = about.select("doc", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page")).where("page >= 0")
    placed = P.chapters(pages, toc, about, B.pages_to_chapters).withColumnsRenamed({"ord": "chapter", "title": "_title"})
    entries = toc.select("doc", F.col("ord").alias("chapter"), "title").unionByName(placed.join(toc.select("doc").distinct(), "doc", "left_anti").select("doc", "chapter", F.col("_title").alias("title")).distinct())
    images = P.read_images(files, extract).withColumn("content", F.sha2("data", 256))
    own = images.join(placed, ["doc", "page"])
    pictures = B.first_of_content(own).select("doc", "chapter", "page", "pos", "image_id")
    image_blocks = pictures.select("doc", "chapter", "page", F.lit(2).alias("part"), F.col("pos").cast("double").alias("top"), F.lit(0).alias("seq"), F.lit("image").alias("type"), "image_id")
    blocks = whole.join(placed.select("doc", "page", "chapter"), ["doc", "page"]).unionByName(image_blocks, allowMissingColumns=True)
    blocks = B.numbered_blocks(blocks, CHAPTER, ["page", "part", "top", "seq"])
    named = own.join(pictures, ["doc", "chapter", "page", "pos"]).select("doc", F.col("name").alias("path"), "image_id", P.image_mime(F.col("name")).alias("mime"), F.lit(None).cast("string").alias("alt"), F.col("content").alias("sha256"), F.col("data").alias("content"))
    return Books(S.whole(blocks).drop("tokens"), entries, named, about.select("doc", "title", "author", F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("cover")))


def read(spark: SparkSession, path: str, **pdf) -> Books:
    """The books of a file, or of all EPUB files of a folder (a path that ends with a slash)."""
    if path.endswith("/"):
        return read_epub(E.scan(spark, path))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if suffix(path) == ".epub":
        return read_epub(files)
    toc = pdf.pop("manual_toc", None)
    if toc is not None and "doc" not in toc.columns:  # contents of the one file, under the name that Spark gives it
        toc = toc.select(F.lit(files.select("path").first()["path"]).alias("doc"), "*")
    return read_pdf(files, manual_toc=toc, **pdf)


def tokens(blocks: DataFrame) -> Column:
    return F.coalesce(count_tokens(block_text(*(F.col(c) for c in ("type", "text", "items", "rows", "caption")))), F.lit(0)).cast("long")


def input_tokens(books: Books) -> DataFrame:
    """(doc, input_tokens): blocks and chapter titles."""
    rows = books.blocks.select("doc", tokens(books.blocks).alias("n")).unionByName(books.titles.select("doc", F.coalesce(count_tokens(F.col("title")), F.lit(0)).cast("long").alias("n")))
    return rows.groupBy("doc").agg(F.sum("n").alias("input_tokens"))


def output_tokens(blocks: DataFrame) -> DataFrame:
    """(doc, output_tokens): blocks alone."""
    return blocks.select("doc", tokens(blocks).alias("n")).groupBy("doc").agg(F.sum("n").alias("output_tokens"))


def estimate(books: Books, *, ratio: float = S.RATIO, chunk_tokens: int = 2000, model: str = "", translate: bool = False) -> DataFrame:
    """(doc, input_tokens, chapters, chunks, prompt_tokens, completion_tokens, calls, pages) without asking a provider."""
    full = S.whole(books.blocks)
    chunks = B.chunk_table(full, CHAPTER, chunk_tokens).groupBy(*CHAPTER).agg(F.max("chunk_no").alias("n")).groupBy("doc").agg(F.sum("n").alias("chunks"))
    held = input_tokens(books).join(books.titles.groupBy("doc").agg(F.count("*").alias("chapters")), "doc").join(chunks, "doc", "left")
    held = held.withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    overshoot = F.lit(cost.CALIBRATIONS[model][1]) if model in cost.CALIBRATIONS else None
    traffic = cost.condense_traffic(F.col("input_tokens"), F.col("chapters"), F.col("chunks"), ratio, translate, overshoot)
    return held.select("doc", "input_tokens", "chapters", "chunks", *(c.alias(n) for n, c in traffic.items()), cost.pages(F.col("input_tokens")).alias("pages"))


def _phase(log: Log, name: str, wanted: DataFrame, keys: list[str], schema: str, compute, tell: Progress | None = None) -> DataFrame:
    """Results of a phase; they are written to the log once and read from there, so that no provider is asked twice."""
    results, new = S.resumed(wanted, log.stored(name, keys), keys, schema, compute)
    done = _once(log, name, results, tell)
    names = [c for c in done.columns if c not in (*keys, "fingerprint", "reused")]
    log.append(name, done.where("not failed and not reused").select(*keys, "fingerprint", F.to_json(F.struct(*names)).alias("result")))
    return done.drop("fingerprint")


def condense(spark: SparkSession, books: Books, provider: Provider, *, model: str = "", ratio: float = S.RATIO, chunk_tokens: int = 2000, log_path: str | None = None, resume: bool = False, tell: Progress | None = None) -> Outcome:
    """Chunks condensed, chapters smoothed and trimmed, and what there is to warn of."""
    if chunk_tokens <= 0:
        raise ValueError("a chunk needs room for a token at least")
    log = Log(spark, log_path, resume)
    keys = [*CHAPTER, "chunk_no"]
    chunks = S.chunk_rows(books.blocks, CHAPTER, chunk_tokens).withColumn("fingerprint", S.chunk_fingerprint(model, ratio))
    condensed = _phase(log, "condense", chunks, keys, S.CONDENSED, lambda rows: S.condense(rows, keys, provider, model=model, ratio=ratio), tell)
    wanted = S.chapters_of(condensed, CHAPTER).withColumn("fingerprint", S.chapter_fingerprint(model, ratio))
    chapters = _phase(log, "synthesize", wanted, CHAPTER, S.SYNTHESIZED, lambda rows: S.synthesize(rows.drop("fingerprint"), CHAPTER, provider, ratio=ratio), tell)
    blocks = S.flattened(chapters, CHAPTER)
    made = Books(blocks, books.titles, S.kept_assets(books.images, chapters, DOC).unionByName(_covers(books)).dropDuplicates(["doc", "image_id"]), books.about)
    sizes = input_tokens(books).join(output_tokens(blocks), "doc", "left").withColumn("output_tokens", F.coalesce("output_tokens", F.lit(0)))
    report = sizes.withColumn("kept_ratio", F.col("output_tokens").cast("double") / F.greatest("input_tokens", F.lit(1)).cast("double"))
    chunk_name = F.concat_ws("-", F.concat(F.lit("ch"), F.col("chapter")), "chunk_no")
    say = lambda df, *parts: df.select("doc", F.concat(*parts).alias("warning"))
    degraded = condensed.select("doc", "degraded").unionByName(chapters.select("doc", "degraded")).groupBy("doc").agg(F.sum("degraded").alias("n")).where("n > 0")
    warnings = [
        say(condensed.where("over_length"), F.lit("chunk "), chunk_name, F.lit(": longer than its source")),
        say(condensed.where("failed"), F.lit("chunk "), chunk_name, F.lit(": could not be condensed and stays as it was")),
        say(chapters.where("failed"), F.lit("chapter "), F.col("chapter").cast("string"), F.lit(": could not be smoothed and stays condensed")),
        say(degraded, F.col("n").cast("string"), F.lit(" passages kept their wording: the reply for them didn't have the expected form")),
        say(C.undershoots(report, ratio), F.lit("condensed to "), F.round(F.col("kept_ratio") * 100).cast("int").cast("string"), F.lit(f" % against a target of {ratio:.0%}; the model is {'' if model in cost.CALIBRATIONS else 'not '}calibrated")),
    ]
    return Outcome(made, {"condense": condensed, "synthesize": chapters}, warnings, report)


def _covers(books: Books) -> DataFrame:
    return books.images.join(books.about.where("cover is not null").select("doc", F.col("cover").alias("image_id")), ["doc", "image_id"], "left_semi")


Progress = Callable[[str, dict[str, int]], None]


def watched(name: str, rows: DataFrame) -> tuple[DataFrame, Observation]:
    """rows, and what is counted of them on the way, in the same pass: rows, reused ones and calls."""
    seen = Observation(name)
    reused = F.count_if("reused") if "reused" in rows.columns else F.lit(0)
    calls = F.coalesce(F.sum(F.size("calls")), F.lit(0)) if "calls" in rows.columns else F.lit(0)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), reused.alias("reused"), calls.cast("long").alias("calls")), seen


def _once(log: Log, name: str, rows: DataFrame, tell: Progress | None = None) -> DataFrame:
    """Rows written once, in the log's folder if it has one, so that no provider is asked twice; then `tell` is told of them."""
    rows, seen = watched(name, rows)
    if log.path:
        rows.write.mode("overwrite").parquet(f"{log.path}/_last/{name}")
        out = log.spark.read.parquet(f"{log.path}/_last/{name}")
    else:
        out = Workspace(log.spark, name).put(rows)
    if tell:
        tell(name, seen.get)
    return out


def translate(
    books: Books, provider: Provider, target: str, *, terms: dict[str, str] | None = None, source: str | None = None, model: str = "",
    log_path: str | None = None, resume: bool = False, tell: Progress | None = None,
) -> Outcome:
    """All texts and titles translated, and the books' language set. Batches that an earlier run stored aren't asked again."""
    log = Log(books.blocks.sparkSession, log_path, resume)
    units = X.marked_units(books.blocks, books.titles, CHAPTER)
    settings = model, source or "", json.dumps(terms or {}, sort_keys=True, ensure_ascii=False)
    stored = log.stored("translate", [*CHAPTER, "batch_start"])
    answers = X.resumed_batches(units, CHAPTER, "place", X.Translator(provider, target, terms, source), stored, target, *settings)
    answers = _once(log, "translate", answers, tell)
    log.append("translate", X.storable(answers, CHAPTER))
    blocks, titles, counts = X.answered_blocks(books.blocks, books.titles, CHAPTER, answers)
    about = books.about.withColumn("language", to_bcp47(F.lit(target)))
    left = counts.groupBy("doc").agg(F.sum("untranslated").alias("n")).where("n > 0")
    warning = left.select("doc", F.concat(F.col("n").cast("string"), F.lit(" segments stay untranslated: no reply for them could be read")).alias("warning"))
    report = input_tokens(books).join(output_tokens(blocks), "doc", "left")
    return Outcome(Books(blocks, titles, books.images, about), {"translate": answers}, [warning], report)


def judge_images(books: Books, provider: V.Seeing, *, model: str = "", log_path: str | None = None, resume: bool = False, tell: Progress | None = None) -> Outcome:
    """Books without the images that the provider finds dispensable, the others under its captions.

    Verdicts of an earlier run are used where the image, what stands around it and the settings are the same.
    """
    log, keys = Log(books.blocks.sparkSession, log_path, resume), [*CHAPTER, "block_index"]
    places = V.contexts(V.rankable(books.blocks, books.images, DOC).unionByName(books.blocks.where("type != 'image'")), CHAPTER)
    told = places.join(books.images.select("doc", "image_id", "content", "mime"), ["doc", "image_id"])
    judged = _once(log, "images", V.resumed_verdicts(told, keys, provider, log.stored("images", keys), model=model), tell)
    log.append("images", V.storable_verdicts(judged, keys))
    blocks = V.ranked(books.blocks, judged, CHAPTER)
    shown = V.references(blocks, books.about, DOC)
    made = Books(blocks, books.titles, books.images.join(shown, ["doc", "image_id"], "left_semi"), books.about)
    return Outcome(made, {"images": judged})


def rank_images(books: Books, provider: V.Seeing, **options) -> Books:
    """The books of `judge_images`."""
    return judge_images(books, provider, **options).books


def chosen(books: Books) -> Books:
    """Books without images that nothing shows, and without places for images that aren't there."""
    blocks, images, _ = V.select(books.blocks, books.images, books.about, DOC)
    return Books(blocks, books.titles, images, books.about)


def _file_names(images: DataFrame) -> DataFrame:
    """images with `name`, distinct within a book: a further image of the same name has its id before it."""
    from pyspark.sql import Window as W

    extension = F.create_map(*(F.lit(x) for kv in {"image/png": ".png", "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/gif": ".gif", "image/svg+xml": ".svg", "image/webp": ".webp"}.items() for x in kv))
    held = images.withColumn("name", image_filename(F.col("path"), F.col("image_id"), F.coalesce(F.try_element_at(extension, F.lower("mime")), F.lit(".bin"))))
    n = F.row_number().over(W.partitionBy("doc", "name").orderBy("image_id"))
    return held.withColumn("_n", n).withColumn("name", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat_ws("-", F.substring("sha256", 1, 8), "_n", "name"))).drop("_n")


def as_markdown(books: Books) -> DataFrame:
    """(doc, markdown)."""
    addresses = _file_names(books.images).select("doc", "image_id", F.concat(F.lit("images/"), "name").alias("address"))
    blocks = R.with_links(books.blocks, addresses, DOC).withColumn("link", F.coalesce("link", "image_id"))
    return R.book_markdown(blocks, books.titles, books.about, DOC)


def as_epub(books: Books) -> DataFrame:
    """(doc, content)."""
    images = _file_names(books.images)
    blocks = E.without_leading_cover(books.blocks, books.about, "doc")
    titles = books.titles.join(books.blocks.select(*CHAPTER).distinct().join(blocks.select(*CHAPTER).distinct(), CHAPTER, "left_anti"), CHAPTER, "left_anti")
    numbers = L.chapter_numbers(titles, DOC, "chapter")
    blocks = blocks.join(numbers, CHAPTER)
    blocks = L.linked(blocks, DOC, L.anchor_locations(blocks, DOC))
    blocks = R.with_links(blocks, images.select("doc", "image_id", F.concat(F.lit("images/"), "name").alias("address")), DOC)
    pages = titles.join(R.to_html(blocks, CHAPTER), CHAPTER, "left")
    chapters = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("chapter", "title", F.coalesce("html", F.lit("")).alias("html")))).alias("chapters"))
    pictures = images.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("name", "mime", F.col("content").alias("data"))), lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)).alias("images"))
    covers = images.select("doc", F.col("image_id").alias("cover"), F.col("name").alias("cover_name"))
    held = books.about.join(chapters, "doc").join(pictures, "doc", "left").join(covers, ["doc", "cover"], "left")
    return E.write_books(held.select("doc", "title", "author", "language", "chapters", "images", F.col("cover_name").alias("cover")), "doc")


def as_html(books: Books) -> DataFrame:
    """(doc, html): one document a book, with its images inside."""
    numbers = L.chapter_numbers(books.titles, DOC, "chapter")
    blocks = books.blocks.join(numbers, CHAPTER)
    blocks = L.linked(blocks, DOC, L.anchor_locations(blocks, DOC), one_file=True)
    blocks = R.with_links(blocks, books.images.select("doc", "image_id", R.data_uri(F.col("mime"), F.col("content")).alias("address")), DOC)
    return R.book_html(blocks, books.titles, books.about, DOC)


def write(books: Books, out: str, asked: list[str]) -> tuple[dict[str, object], list[str]]:
    """(where each format was written, warnings). One file a book, named by its own file."""
    stem = F.regexp_replace(P.file_stem(F.col("doc")), r"[^A-Za-z0-9._-]", "_")

    def put(rows: DataFrame, ending: str) -> str:
        name = F.concat(stem, F.lit(ending))
        store(rows.select(name.alias("file"), F.col("content").cast("binary").alias("content")), out)
        return f"{out}/*{ending}"

    def markdown() -> str:
        images = _file_names(books.images)
        store(images.select(F.concat(F.lit("images/"), "name").alias("file"), "content"), out)
        return put(as_markdown(books).withColumnRenamed("markdown", "content"), ".md")

    def pdf() -> str:
        make = R.pdf_writer()
        # One document a row: a book is whole in any case, and its pages aren't worth a batch.
        made = F.udf(lambda html: make(html), "binary", useArrow=True)
        return put(as_html(books).select("doc", made("html").alias("content")), ".pdf")

    return R.each(asked, {"md": markdown, "epub": lambda: put(as_epub(books), ".epub"), "pdf": pdf})
