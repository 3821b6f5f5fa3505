"""Quality rules: plain limits, then robust outlier rejection by minimum covariance determinants.

Each group (language and source) gets a centre and covariance by deterministic MCD: from a start at the medians
and median deviations, concentration steps keep the share of rows with the least Mahalanobis distance and refit
on it. All steps are grouped sums and mergeable quantile sketches over all rows, so no group, however large,
meets in one task. Groups too small for a covariance use the fit of their language, and those of all rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliant.llm.kernels import NOT_SPACE, U, Block, mix, per_block, row_sums, span_hash
from foliant.workspace import Workspace

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"[#*$%&|<>]"[1:-1])] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
#: Statistic vector, with the least standard deviation that each component is granted.
STATS = {
    "x_length": ("ln(greatest(word_chars, 1) / greatest(n_words, 1))", 0.05),
    "x_symbols": ("sqrt(n_symbols / greatest(word_chars, 1))", 0.03),
    "x_lines": ("sqrt(n_dup_lines / greatest(n_lines, 1))", 0.1),
    "x_repeats": ("sqrt(n_repeat_words / greatest(n_words, 1))", 0.05),
    "x_upper": ("sqrt(n_upper / greatest(word_chars, 1))", 0.03),
}


def count(block: Block) -> dict[str, np.ndarray]:
    """The counts of each row of a block."""
    data, offsets = block.data, block.offsets
    prefix = block.prefix()
    starts, ends, first = block.spans(NOT_SPACE)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    marked = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets])
    newlines = np.flatnonzero(data == 10)
    row_of = np.searchsorted(offsets, newlines, "right") - 1
    inner = newlines + 1 < offsets[row_of + 1]
    line_starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], newlines[inner] + 1]))
    line_rows = np.searchsorted(offsets, line_starts, "right") - 1
    # Up to the next newline, or the end of the row itself (not that of the row before, where the first line starts).
    line_ends = np.minimum(np.append(newlines, len(data))[np.searchsorted(newlines, line_starts)], offsets[line_rows + 1])
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_rows = line_starts[worded], line_ends[worded], line_rows[worded]
    salt = np.arange(block.rows, dtype=U) * U(0x9E3779B97F4A7C15)
    lines = np.bincount(line_rows, minlength=block.rows)
    keys = mix(span_hash(prefix, line_starts, line_ends) + salt[line_rows])
    _, at = np.unique(keys, return_index=True)
    distinct = np.bincount(line_rows[at], minlength=block.rows)

    words = span_hash(prefix, starts, ends)
    n = np.diff(first)
    word_rows = np.repeat(np.arange(block.rows), n)
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= 3:
        window = (words[:-2] * U(3) + words[1:-1]) * U(0xD6E8FEB86659FD93) + words[2:]
        at = np.flatnonzero(word_rows[:-2] == word_rows[2:])
        keys = mix(window[at] + salt[word_rows[at]])
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + 3, -1) if len(hit) else None
    repeated = np.cumsum(covered[:-1]) > 0
    return {
        "n_words": n,
        "word_chars": row_sums(points[ends] - points[starts], first),
        "n_symbols": marked(SYMBOLS),
        "n_dup_lines": lines - distinct,
        "n_repeat_words": row_sums(repeated.astype(np.int64), first),
        "n_lines": lines,
        "n_upper": marked(UPPER),
    }


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts, one row per row of docs."""

    def one(part: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(x, pa.int64()) for x in count(block).values())], ["doc_id", "lang", "source", *COUNTS])

    picked = docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")), "text")
    return picked.mapInArrow(per_block(one), "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 1000):
        term *= x / (a + i)
        total += term
        if term < total * 1e-15:
            break
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a))) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance from columns `names` and the fitted array columns centre and inverse."""
    p = len(names)
    d = [F.col(n) - F.col("centre")[i] for i, n in enumerate(names)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + (1 if i == j else 2) * d[i] * d[j] * F.col("inverse")[i * p + j]
    return total


def _fit(sums: DataFrame, keys: list[str], p: int, floors: list[float], factor: float) -> DataFrame:
    """Centre, inverse covariance and its determinant's logarithm for each row of sums (n, s_i, s_ij)."""
    kinds = dict(sums.dtypes)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def run(batches):
        for rows in batches:
            out = rows[[*keys, "n"]].copy()
            centres, inverses, sizes = [], [], []
            for r in rows.itertuples(index=False):
                n = max(float(r.n), 1.0)
                mean = np.array([getattr(r, f"s{i}") for i in range(p)], float) / n
                cov = np.zeros((p, p))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = getattr(r, f"s{i}_{j}") / n - mean[i] * mean[j]
                cov = factor * cov + np.diag(np.square(floors))
                centres.append(mean)
                inverses.append(np.linalg.pinv(cov).ravel())
                sizes.append(float(np.linalg.slogdet(cov)[1]))
            out["centre"], out["inverse"], out["logdet"] = centres, inverses, sizes
            yield out

    return sums.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, centre array<double>, inverse array<double>, logdet double")


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    names, p = list(STATS), len(STATS)
    first = [F.sum(n).alias(f"s{i}") for i, n in enumerate(names)]
    second = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *first, *second)


def _starts(rows: DataFrame, work: Workspace) -> DataFrame:
    """(g, start, centre, inverse, logdet): from medians and their absolute deviations, and from the moments of all rows."""
    names, p = list(STATS), len(STATS)
    floors = [f for _, f in STATS.values()]
    middle = work.put(rows.groupBy("g").agg(F.array(*(F.percentile_approx(n, 0.5, 1000) for n in names)).alias("m")), "medians")
    apart = (F.percentile_approx(F.abs(F.col(n) - F.col("m")[i]), 0.5, 1000).alias(f"d{i}") for i, n in enumerate(names))
    spread = rows.join(middle, "g").groupBy("g").agg(F.first("m").alias("centre"), *apart)
    inverse = F.array(*(1 / (F.pow(1.4826 * F.col(f"d{i}"), 2) + floors[i] ** 2) if i == j else F.lit(0.0) for i in range(p) for j in range(p)))
    first = spread.select("g", F.lit(0).alias("start"), "centre", inverse.alias("inverse"), F.lit(math.inf).alias("logdet"))
    whole = _fit(_moments(rows, ["g"]), ["g"], p, floors, 1.0)
    return first.unionByName(whole.select("g", F.lit(1).alias("start"), "centre", "inverse", F.lit(math.inf).alias("logdet")))


def robust_fits(spark: SparkSession, rows: DataFrame, work: Workspace, *, most_steps: int = 20, share: float = 0.75, settled: float = 1e-6) -> DataFrame:
    """MCD fit of each group g of rows with the columns of STATS: g, n, centre, inverse, logdet.

    From each of two starts, concentration steps fit the share of rows that lies nearest to the last fit, until a group's log
    determinant falls by no more than `settled`; then its rows take part no more. Of the two fits of a group the one with
    the lesser determinant stays.
    """
    names, p, keys = list(STATS), len(STATS), ["g", "start"]
    floors = [f for _, f in STATS.values()]
    cut = chi2_quantile(share, p)
    factor = share / max(chi2_cdf(cut, p + 2), 1e-9)
    moving, done = work.put(_starts(rows, work), "start"), []
    for step in range(most_steps):
        far = rows.join(moving.select(*keys, "centre", "inverse"), "g").withColumn("d2", _distance(names))
        limit = work.put(far.groupBy(*keys).agg(F.percentile_approx("d2", share, 2000).alias("most")), f"limit{step}")
        near = far.select(*keys, *names, "d2").join(limit, keys).where("d2 <= most")
        now = _fit(_moments(near, keys), keys, p, floors, factor).join(moving.select(*keys, F.col("logdet").alias("before")), keys)
        now = work.put(now.withColumn("open", F.col("before") - F.col("logdet") > settled), f"fit{step}")
        last = step == most_steps - 1
        done.append(now if last else now.where("not open"))
        moving = now.where("open")
        if last or moving.isEmpty():
            break
    best = F.min_by(F.struct("n", "centre", "inverse", "logdet"), F.struct("logdet", "start")).alias("b")
    return work.put(reduce(DataFrame.unionByName, done).groupBy("g").agg(best).select("g", "b.*"), "fits")


def judge(docs: DataFrame, *, quantile: float = 1 - 1e-9, least_rows: int = 50, least_words: int = 50, short: int = 300) -> DataFrame:
    """doc_id, the counts, base_failed, distance, kept; one row per row of docs.

    A row is kept if it passes the base limits and its squared distance, divided by 1 + short / n_words for the
    noise of short texts, is within the chi-squared quantile; one at the limit is kept. Null texts count nothing and fail;
    null languages and sources form groups of their own. Texts of any length are counted whole. Repeated rows count each;
    an empty table gives an empty result. Columns besides doc_id, text, lang and source are not read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "quality")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = text_counts(docs).select("*", failed.alias("base_failed"), *(F.expr(e).alias(n) for n, (e, _) in STATS.items()), *(F.coalesce(c, F.lit("\0")).alias(f"key_{c}") for c in ("lang", "source")))
    stats = work.put(stats, "stats")
    sound = stats.where("not base_failed")
    sizes = work.put(sound.groupBy("key_lang", "key_source").agg(F.count("*").alias("rows")), "sizes")
    by_lang = sizes.groupBy("key_lang").agg(F.sum("rows").alias("lang_rows"))
    group = (
        F.when(F.col("rows") >= least_rows, F.concat_ws("|", F.lit("s"), "key_lang", "key_source"))
        .when(F.col("lang_rows") >= least_rows, F.concat_ws("|", F.lit("l"), "key_lang"))
        .otherwise(F.lit("all"))
    )
    sizes = work.put(sizes.join(by_lang, "key_lang").select("key_lang", "key_source", group.alias("g")), "groups")
    grouped = work.put(sound.join(sizes, ["key_lang", "key_source"]).select("g", "key_lang", *STATS), "grouped")
    levels = (
        grouped.where("g like 's|%'").select("g", *STATS)
        .unionByName(grouped.select(F.concat_ws("|", F.lit("l"), "key_lang").alias("g"), *STATS))
        .unionByName(grouped.select(F.lit("all").alias("g"), *STATS))
    )
    needed = grouped.select("g").distinct()
    fits = robust_fits(spark, work.put(levels.join(needed, "g", "left_semi"), "levels"), work)
    work.only(stats, sizes, fits)
    joined = stats.join(sizes, ["key_lang", "key_source"], "left").join(fits.select("g", "centre", "inverse"), "g", "left")
    d2 = _distance(list(STATS)) / (1 + short / F.greatest("n_words", F.lit(1)))
    most = chi2_quantile(quantile, len(STATS))
    return joined.withColumn("distance", F.when(~F.col("base_failed"), d2)).select(
        "doc_id", *COUNTS[:5], "base_failed", F.col("distance"), (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= most)).alias("kept")
    )
