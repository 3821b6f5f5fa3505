"""URL filter: host and path rules first, then a logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliant.llm.kernels import U, Block, mix, powers, row_sums, text_buffers

#: (host, path prefix, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

# The labelled table is made of names by this rule: each stands in two urls, and both classes share all else, top-level
# domains, prefixes and paths, so that only names tell them apart. Three in four are harmless, as pages are.
BAD = """
    win-casino bonus-slots poker-online casino-jackpot bet-sports lottery-prize xxx-videos adult-hot adult-dating porn-tube sexy-cams
    escort-city cheap-pills viagra-store miracle-diet torrent-crack warez-keygen payday-loan fast-cash get-rich crypto-double
    ads-click spam-links spam-seo free-followers phish-login malware-setup replica-watches
"""
GOOD = """
    docs library university physics-notes daily-news encyclopedia gardening museum hospital recipes city-council science-journal
    forum-linux school weather archive travel-guide programming theatre maps dictionary orchestra history kids-stories bank river
    paintings lectures northfield harlow stonebridge anderson tillman thornton hanover ottersen therin latham bleston rehaus
    dement-online nations intheland onward ingham thessen erland mentors aurelle quedon lavigne cordero schuler reichen
    nichter aulich ouvrier enseigne treville parament station-house edition athlone ounders thandor wherever bleriot
    elanor vision-care render horticulture menton fromage pourquoi avecplus sinfonia perolas
"""
DOMAINS = ("pages.com", "site.net", "portal.org", "example.info", "home.co")
PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("/", "/en/12", "/article/7.html", "/de/301?x=1", "/2024/page#top", "/fr/99/", "/index.php")


def labelled_urls(bad: str = BAD, good: str = GOOD, turns: tuple[int, ...] = (0, 1)) -> tuple[tuple[str, int], ...]:
    """(url, 1 if it is to be blocked): each name once for each turn, in another domain, prefix and path."""
    out = []
    for label, names in ((1, bad.split()), (0, good.split())):
        for i, name in enumerate(names):
            for turn in turns:
                at = i + 3 * turn
                host = PREFIXES[at % len(PREFIXES)] + name + "." + DOMAINS[at % len(DOMAINS)]
                out.append((f"https://{host}{PATHS[at % len(PATHS)]}", label))
    return tuple(out)


LABELLED = labelled_urls()
SIZES, BITS = (3, 4, 5), 16


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A to Z lower-cased; empty without `://` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct<rule, verdict>, else null."""
    out = F.lit(None)
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each row, and the row's first (rows + 1). Rows are hosts and paths parted by a space."""
    block = Block(data, offsets)
    prefix, (_, inverse), n = block.prefix(), powers(len(data) + 1), len(data)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    hashes, rows = [], []
    row = np.repeat(np.arange(block.rows), np.diff(offsets))
    for k in SIZES:
        at = np.flatnonzero(np.arange(n) + k <= ends)
        hashes.append(mix((prefix[at + k] - prefix[at]) * inverse[at] + U(k)) & U((1 << BITS) - 1))
        rows.append(row[at])
    bucket, row = np.concatenate(hashes).astype(np.int64), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return bucket[order], np.searchsorted(row[order], np.arange(block.rows + 1))


class UrlModel:
    """Weights by bucket and a bias, fitted by full-batch gradient steps on the labelled table."""

    def __init__(self, labelled=LABELLED, steps: int = 1500, rate: float = 8.0, decay: float = 2e-5):
        import re

        keys = [m[1].lower() + " " + m[2] for u, _ in labelled for m in [re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)]]
        y = np.array([label for _, label in labelled], float)
        bucket, first = grams(*text_buffers(pa.array(keys)))
        row, per = np.repeat(np.arange(len(keys)), np.diff(first)), np.maximum(np.diff(first), 1)
        self.weights, self.bias = np.zeros(1 << BITS), 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-self._raw(bucket, first)))
            error = (p - y) / np.sqrt(per)
            self.weights -= rate * (np.bincount(bucket, error[row], 1 << BITS) / len(y) + decay * self.weights)
            self.bias -= rate * 0.1 * np.mean(p - y)

    def _raw(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        return row_sums(self.weights[bucket], first) / np.sqrt(np.maximum(np.diff(first), 1)) + self.bias

    def score(self, keys: pa.Array) -> np.ndarray:
        """Probability of a block for each `host path`."""
        data, offsets = text_buffers(keys)
        return 1 / (1 + np.exp(-self._raw(*grams(data, offsets)))) if len(keys) else np.zeros(0)


def filter_urls(pages: DataFrame, rules=RULES, labelled=LABELLED, threshold: float = 0.5) -> DataFrame:
    """A verdict for each row: page_id, host, path, rule, verdict, score.

    Null urls and urls without `://` have an empty host and path and go to the model; a score at the threshold blocks.
    Urls of any length are read whole, and of several rules that fit the longest wins. Repeated rows and rows without a
    page_id are judged one by one; an empty table gives an empty result; other columns are not read.
    """
    model = UrlModel(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(model.score(batch.column(5)))], ["page_id", "host", "path", "rule", "said", "score"])

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
        .select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("said"), F.concat_ws(" ", "host", "path").alias("key"))
    )
    kind = dict(pages.dtypes)["page_id"]
    scored = judged.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, said string, score double")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
