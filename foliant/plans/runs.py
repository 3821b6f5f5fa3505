"""Queries over what a run leaves: reuse of earlier results, what its calls took, and the log itself."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from foliant.operators import blocks as B, reply_columns as RC, stages as S, translate as X, vision as V
from foliant.plans import catalogue as C
from foliant.streaming.log import Log
from foliant.workspace import Workspace

query = C.query


class _Marks:
    """Marks each text of a batch."""

    def __call__(self, batch: dict[str, str]) -> str:
        return json.dumps({"translations": {i: "» " + t for i, t in batch.items()}})


def _stored_batches(spark, d, units: DataFrame) -> DataFrame:
    """A log in which every batch's answer says where it is from, but some are spoilt: by the chapter's number one has
    another fingerprint, lacks a unit, has one too many, holds a number, or is torn."""
    by = ["chapter", "batch_start"]
    n, some = F.col("chapter") % 11, F.struct(F.lit("x").alias("k"), F.lit("extra").alias("v"))
    numbered = X.unit_batches(units, ["chapter"], "place")
    pair = F.struct(F.col("unit").cast("string").alias("k"), F.concat(F.lit("stored "), "text").alias("v"))
    held = numbered.groupBy(*by).agg(F.array_sort(F.collect_list(pair)).alias("p"))
    p = F.when(n == 2, F.slice("p", 2, F.size("p"))).when(n == 3, F.array_append("p", some)).otherwise(F.col("p"))
    said = F.to_json(F.map_from_entries(p))
    said = F.when(n == 4, F.lit('{"0": 1}')).when(n == 5, F.left(said, F.length(said) - 1)).when(n == 6, F.lit("[]")).otherwise(said)
    prints = X.batch_fingerprints(numbered, ["chapter"], "Spanish").withColumn("fingerprint", F.when(F.col("chapter") % 11 == 1, "old").otherwise(F.col("fingerprint")))
    return held.withColumn("result", said).join(prints, by).select(*by, "fingerprint", "result").where("chapter % 11 < 9")


@query(f"""{C._UNITS} SELECT chapter, unit::INT AS unit, CASE WHEN chapter % 11 IN (0, 7, 8) THEN 'stored ' ELSE '» ' END || text AS text, chapter % 11 IN (0, 7, 8) AS reused FROM u""")
def translate_resume(spark, d):
    """Stored batches are used only if fingerprint and exact set of units agree; all others are asked for again."""
    units = C._units(spark, d)
    log = _stored_batches(spark, d, units)
    return X.resumed_batches(units, ["chapter"], "place", _Marks(), log, "Spanish").select("chapter", "unit", "text", "reused")


@query(f"""{C._UNITS}, b AS (SELECT chapter, unit // 40 * 40 AS s, bool_and(length(text) % 29 > 0) AS whole FROM u GROUP BY ALL) SELECT 'translate' AS phase, count(*) AS total, count_if(whole)::BIGINT AS reused FROM b""")
def translate_reuse_counters(spark, d):
    """A second run over the log of a first one, whose torn batches weren't stored."""
    units, keys = C._units(spark, d), ["chapter"]
    work = Workspace(spark, "translate-twice")
    first = work.put(X.resumed_batches(units, keys, "place", C._echo, None, "Spanish"), "first")
    log = work.put(X.storable(first, keys), "log")
    return X.batch_counters(X.resumed_batches(units, keys, "place", C._echo, log, "Spanish"), keys)


_CONTEXT = """length(left(array_to_string(list_filter(['Current caption: ' || text, before, after], lambda x: coalesce(x, '') <> ''), chr(10)), 600))"""


@query(f"""{C._TYPED}, n AS (SELECT chapter, block_index, type, text,
    last_value(CASE WHEN type IN ('heading', 'paragraph', 'quote') THEN text END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    first_value(CASE WHEN type IN ('heading', 'paragraph', 'quote') THEN text END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY block_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM typed),
  c AS (SELECT chapter, block_index, {_CONTEXT} AS n FROM n WHERE type = 'image')
  SELECT chapter, block_index, n % 11 <> 0 AND chapter % 3 > 0 AS reused, n % 11 = 0 OR (n % 7 <> 0 AND n % 10 >= 5) AS keep FROM c""")
def image_resume(spark, d):
    """A second run over a first one's verdicts: those that couldn't be read aren't stored, and every third chapter's images have changed."""
    keys = ["chapter", "block_index"]
    told = V.contexts(C._blocks(spark, d), ["chapter"]).withColumns({"content": F.lit("x").cast("binary"), "mime": F.lit("image/png")})
    work = Workspace(spark, "images-twice")
    first = work.put(V.resumed_verdicts(told, keys, C._Eye(), None), "first")
    log = work.put(V.storable_verdicts(first, keys), "log")
    now = told.withColumn("content", F.when(F.col("chapter") % 3 == 0, F.lit("y").cast("binary")).otherwise(F.col("content")))
    return V.resumed_verdicts(now, keys, C._Eye(), log).select(*keys, "reused", "keep")


class _Metered:
    """Answers like the default, and reports the blocks and runs of a prompt as its tokens; some reports lack a count."""

    def __init__(self):
        from foliant.functions.provider import Extracting

        self.inner, self.told = Extracting(), None

    def generate(self, system: str, user: str) -> str:
        blocks, runs = user.count("\n[BLOCK "), user.count("\n[TEXT ")
        self.told = {"prompt_tokens": blocks, "completion_tokens": None if blocks % 5 == 0 else runs} | ({"cached_tokens": 2} if runs % 2 else {})
        return self.inner.generate(system, user)

    def usage(self):
        return self.told


@query(f"""{C._BLOCKCHUNKS}, s AS (SELECT *, prose AND NOT coalesce(lag(prose) OVER (PARTITION BY chapter, chunk_no ORDER BY block_index), false) AS st FROM words),
  c AS (SELECT chapter, chunk_no, count_if(prose) AS blocks, sum(st::INT) AS runs FROM s GROUP BY ALL)
  SELECT 'condense' AS phase, chapter, count_if(runs > 0)::BIGINT AS calls, coalesce(sum(blocks) FILTER (WHERE runs > 0), 0)::BIGINT AS prompt_tokens,
    coalesce(sum(runs) FILTER (WHERE runs > 0 AND blocks % 5 > 0), 0)::BIGINT AS completion_tokens, (2 * count_if(runs % 2 = 1))::BIGINT AS cached_tokens
  FROM c GROUP BY chapter""")
def run_usage(spark, d):
    """What the calls of a run took, by phase and chapter, from the same pass that made the results."""
    work = Workspace(spark, "usage")
    done = work.put(S.condense(C._chunk_rows(spark, d), ["chapter", "chunk_no"], _Metered()), "condensed")  # one pass, read twice
    return S.usage({"condense": done}, ["chapter"])


def _event_log(spark, d, name: str) -> tuple[Log, DataFrame]:
    """A log to which the events were appended in four parts, oldest first."""
    log = Log(spark, f"{Workspace(spark, name).root}", True)
    events = C.table(spark, d, "events").select("user_id", "event_type", "event_id", "props")
    for part in range(4):
        # Each part has a write of each key at most, as a run of the engine has.
        own = events.where(F.col("event_id") % 4 == part).groupBy("user_id", "event_type").agg(F.max_by("props", "event_id").alias("props"))
        log.append("events", own)
    return log, events


_LAST_PART = """WITH p AS (SELECT user_id, event_type, event_id % 4 AS part, arg_max(props, event_id) AS props FROM events GROUP BY ALL)
  SELECT user_id, event_type, arg_max(props, part) AS props FROM p GROUP BY ALL"""


@query(_LAST_PART)
def log_appends(spark, d):
    """Last write wins by the number of the append, not by a clock."""
    return _event_log(spark, d, "log")[0].stored("events", ["user_id", "event_type"])


@query(_LAST_PART)
def log_compaction(spark, d):
    """The same view after the log was compacted, appended to and compacted again."""
    log, events = _event_log(spark, d, "compacted")
    keys = ["user_id", "event_type"]
    log.compact("events", keys)
    again = events.where(F.col("event_id") % 4 == 3).groupBy(*keys).agg(F.max_by("props", "event_id").alias("props"))
    log.append("events", again)
    log.compact("events", keys, now=True)
    return log.stored("events", keys)


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(props, event_id) AS props FROM events GROUP BY user_id, event_type")
def log_stream_merge(spark, d):
    """A stream of event files, one a micro-batch, merged into the log under batch numbers."""
    source = C.table(spark, d, "events").select("user_id", "event_type", "event_id", "props")
    work = Workspace(spark, "merge")
    folder = f"{work.root}/files"
    source.repartition(3, "event_id").write.parquet(folder)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    log, keys = Log(spark, f"{work.root}/log", True), ["user_id", "event_type"]
    running = log.merged("events", keys, stream, f"{work.root}/checkpoint", "event_id")
    running.awaitTermination()
    return log.view("events", keys, "event_id")


@query(f"""{C._TYPED}, t AS (SELECT chapter, run_id, list(text ORDER BY block_index) AS t, bool_and(type = 'paragraph') AS plain, (chapter + run_id) % 8 AS k FROM runs WHERE run_id IS NOT NULL GROUP BY chapter, run_id),
  d AS (SELECT *, len(t) AS n, k = 7 OR (NOT plain AND k IN (2, 3, 4)) OR (k = 1 AND len(t) > 1) AS degraded FROM t)
  SELECT chapter, run_id, degraded, array_to_string(CASE WHEN degraded THEN t WHEN k = 2 THEN ['a', 'b'] WHEN k = 4 THEN list_transform(range(n + 1), lambda i: 'x') ELSE list_transform(t, lambda x: '~' || x || '~') END, '|') AS texts,
    array_to_string(CASE WHEN degraded OR k IN (0, 1, 3, 6) THEN list_transform(range(1, n + 1), lambda i: i::VARCHAR) WHEN k = 2 THEN ['-', '-'] WHEN k = 4 THEN list_transform(range(n + 1), lambda i: '-') ELSE list_transform(t, lambda i: '1') END, ',') AS sources FROM d""")
def reply_columns(spark, d):
    """Replies of eight kinds to the runs of all chapters, read without a Python worker."""
    r = B.runs(C.typed(spark, d), ["chapter"]).where("run_id is not null")
    own = F.array_sort(F.collect_list(F.struct("block_index", "type", "text")))
    held = r.groupBy("chapter", "run_id").agg(own.alias("b")).withColumn("k", (F.col("chapter") + F.col("run_id")) % 8)
    wave = lambda x: F.concat(F.lit("~"), x["text"], F.lit("~"))
    entry = lambda block: lambda x, i: F.struct(block(i).alias("block"), x["type"].alias("type"), wave(x).alias("text"))
    n = F.size("b")
    reply = (
        F.when(F.col("k") == 0, F.to_json(F.transform("b", entry(lambda i: i + 1)))).when(F.col("k") == 1, F.to_json(F.transform("b", entry(lambda i: n - i))))
        .when(F.col("k") == 2, F.lit('"a\\n \\n b"')).when(F.col("k") == 3, F.to_json(F.transform("b", wave)))
        .when(F.col("k") == 4, F.to_json(F.array_repeat(F.lit("x"), n + 1))).when(F.col("k") == 5, F.to_json(F.transform("b", entry(lambda i: F.lit("1")))))
        .when(F.col("k") == 6, F.to_json(F.transform("b", entry(lambda i: F.lit(True))))).otherwise(F.lit('[{"block": 1'))
    )
    blocks = F.transform("b", lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text"), F.lit(None).cast("array<string>").alias("items")))
    read = RC.with_rebuilt(held.select("chapter", "run_id", blocks.alias("blocks"), reply.alias("reply")), "blocks", "reply")
    joined = lambda f, by: F.array_join(F.transform("pieces", f), by)
    sources = joined(lambda p: F.coalesce(p["source"].cast("string"), F.lit("-")), ",")
    return read.select("chapter", "run_id", "degraded", joined(lambda p: p["text"], "|").alias("texts"), sources.alias("sources"))


@query(f"""{C._BLOCKCHUNKS}, c AS (SELECT chapter, chunk_no, bool_or(prose) AS asked FROM words GROUP BY ALL)
  SELECT 'condense' AS phase, count(*) AS rows, count_if(chapter % 2 = 0 AND chapter % 4 <> 0)::BIGINT AS reused, count_if(asked AND NOT (chapter % 2 = 0 AND chapter % 4 <> 0))::BIGINT AS calls FROM c""")
def phase_progress(spark, d):
    """What a phase counts of its rows while it writes them; of even chapters' stored results every second chapter's is outdated."""
    from foliant.engine import watched

    keys, work = ["chapter", "chunk_no"], Workspace(spark, "progress")
    wanted = C._chunk_rows(spark, d).withColumn("fingerprint", S.chunk_fingerprint("", 0.3))
    run = lambda rows: S.condense(rows, keys, _Metered())
    log = work.put(S.resumed(wanted.where("chapter % 2 = 0"), None, keys, S.CONDENSED, run)[1], "log")
    log = log.withColumn("fingerprint", F.when(F.col("chapter") % 4 == 0, "old").otherwise(F.col("fingerprint")))
    rows, seen = watched("condense", S.resumed(wanted, log, keys, S.CONDENSED, run)[0])
    work.put(rows, "results")
    return spark.createDataFrame([("condense", *(seen.get[n] for n in ("rows", "reused", "calls")))], "phase string, rows long, reused long, calls long")
