"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

Every text gets 48 consistent weighted samples of its five-word shingles, in twelve bands of four. In a bucket,
all members are held against its first one, so that a large group of copies costs one comparison each, and what is
similar is contracted to components. Texts of different components that may still be similar are then found by the
prefix filter, exactly, among all texts that share a bucket with any other: ordered from rare to frequent, similar
texts share a shingle among those that come before the last 0.8 of their weights. At the first shingle that two texts
share, what is left of both bounds their overlap; so the lighter of the two holds it among those before the last
2 * 0.8 / 1.8 of its weight, and the other's total lies within narrow bounds. Each comparison is verified on the
whole weighted sets. Where a large group of near copies makes many such pairs at a shingle, those of a few texts chosen by
hash come first and are contracted, twice; then come all pairs of what are still different components, so the result is
exact. Shingles with few pairs meet once.

The inverse document frequency is ln(1 + N / (df + N / 2)): the added half damps it, so that what a group of near
copies shares isn't outweighed by its few edits. Frequencies are counted in a table of 2**16 hash buckets, whose
size is fixed and whose error, relative to N, is too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm.graph import components, fresh_names, text_keys
from foliant.llm.kernels import NOT_SPACE, U, Block, blocks, mix, row_sums, shingles, span_hash
from foliant.workspace import Workspace

WORDS = 5
BANDS, ROWS = 12, 4
#: Where a key holds over DENSE pairs of different components a member, the pairs that one text in SHARES makes with a few
#: members of each component come first: what these connect needs no further pair. All others come last in any case.
#: A key of over LEAD members is parted by the component that leads it.
DENSE, DELEGATES, SHARES, LEAD = 8, 4, (64, 8), 32
#: Steps of totals; slack for sums of floats; how many earlier keys a member carries, to see where a pair met before.
STEP, EDGE, BEFORE = 1.02, 1e-5, 32
#: Shingles of this inverse document frequency or more are marked in a bitmap of so many longs.
RARE, MARKS = 1.0, 4
DF_BITS = 16
ID_BITS = 44
_ID = U((1 << ID_BITS) - 1)


def weighted_shingles(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle ids by row, how often each occurs, and each row's first (rows + 1)."""
    starts, ends, first = block.spans(NOT_SPACE)
    words = span_hash(block.prefix(), starts, ends)
    all_, at = shingles(words, first, WORDS)
    row = np.repeat(np.arange(block.rows, dtype=U), np.diff(at))
    keys, counts = np.unique((row << U(ID_BITS)) | (all_ & _ID), return_counts=True)
    return keys & _ID, counts, np.searchsorted(keys >> U(ID_BITS), np.arange(block.rows + 1, dtype=U))


def frequency_table(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency by hash bucket: 2**16 values, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, block in blocks(batch):
                ids, _, _ = weighted_shingles(block)
                counts += np.bincount((ids & U((1 << DF_BITS) - 1)).astype(np.int64), minlength=1 << DF_BITS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[at], rows))], ["bucket", "n"])

    summed = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << DF_BITS)
    own = summed[summed.bucket >= 0]
    df[own.bucket] = own.n
    total = float(summed[summed.bucket < 0].n.sum()) or 1.0
    # Shared buckets add what all shingles spread evenly add.
    df = np.maximum(df - np.median(df), 0)
    return np.log1p(total / (df + total / 2)).astype(np.float32)


def _gamma2(bits: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    low, high = np.zeros_like(p), np.full_like(p, 60.0)
    for _ in range(80):
        mid = (low + high) / 2
        less = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


class Sampler:
    """Consistent weighted samples; each is the least value, which only equal shingles and steps share."""

    def __init__(self, count: int = BANDS * ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(1, 1 << 63, (count, 2), dtype=np.uint64) | U(1)
        self.r, self.log_c = _gamma2(12).astype(np.float32), np.log(_gamma2(16)).astype(np.float32)
        self.beta = ((np.arange(4096) + 0.5) / 4096).astype(np.float32)

    def __call__(self, ids: np.ndarray, log_w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows x samples; rows without shingles are all 0."""
        some = np.flatnonzero(np.diff(first))
        out = np.zeros((len(first) - 1, len(self.factors)), np.float32)
        if not len(some):
            return out
        for k, (a, b) in enumerate(self.factors):
            h = ids * a
            h ^= h >> U(29)
            h *= b
            r = self.r[(h >> U(52)).astype(np.int64)]
            beta = self.beta[((h >> U(40)) & U(4095)).astype(np.int64)]
            t = np.floor(log_w / r + beta)
            value = self.log_c[((h >> U(24)) & U(65535)).astype(np.int64)] - r * (t - beta + 1)
            out[some, k] = np.minimum.reduceat(value, first[some])
        return out


def signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, h1, h2, row and band hashes of each row; no bands for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, table = Sampler(), idf.value
        log_table = np.log(table)
        for batch in batches:
            for part, block in blocks(batch):
                ids, counts, first = weighted_shingles(block)
                bucket = (ids & U((1 << DF_BITS) - 1)).astype(np.int64)
                log_w = log_table[bucket] + np.log(counts.astype(np.float32))
                sketch = sample(ids, log_w, first).view(np.uint32).astype(U)
                keys = np.zeros((block.rows, BANDS), U)
                for j in range(ROWS):
                    keys = mix(keys * U(31) + sketch[:, j::ROWS] + U(j + 1))
                filled = np.diff(first) > 0
                at = np.concatenate([[0], np.cumsum(filled * BANDS)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[filled].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], bands], ["doc_id", "h1", "h2", "row", "bands"])

    return docs.select("doc_id", *text_keys(), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, "doc_id long, h1 long, h2 long, row long, bands array<long>")


def weighted_sets(docs: DataFrame, idf, least: float) -> DataFrame:
    """node, sorted 32-bit shingle ids, their weights and total, the ids of the prefix for similarities from `least`, what of the total is left at each, and the bitmap of rare shingles."""
    marks = [f"mark{i}" for i in range(MARKS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch):
                ids, counts, first = weighted_shingles(block)
                rarity = idf.value[(ids & U((1 << DF_BITS) - 1)).astype(np.int64)]
                weights = (rarity * counts).astype(np.float32)
                small = (ids >> U(12)).astype(np.uint32)  # still sorted within a row
                cells = []
                for a, b in zip(first, first[1:]):
                    order = np.lexsort((small[a:b], -rarity[a:b]))
                    before = np.cumsum(weights[a:b][order], dtype=float)
                    total = before[-1] if b > a else 0.0
                    short = int(np.searchsorted(before, (1 - least) * total * (1 + 1e-6), "right")) + 1
                    left = np.concatenate([[total], total - before])[:short]
                    bits = np.zeros(64 * MARKS, bool)
                    bits[(small[a:b][rarity[a:b] >= RARE] * np.uint32(0x9E3779B1) >> np.uint32(16)) % (64 * MARKS)] = True
                    cells.append((small[a:b].tobytes(), weights[a:b].tobytes(), total, small[a:b][order[:short]].view(np.int32), left[: b - a], *np.packbits(bits).view(np.int64).tolist()))
                types = (pa.binary(), pa.binary(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), *[pa.int64()] * MARKS)
                columns = [pa.array([c[i] for c in cells], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["node", "ids", "weights", "total", "prefix", "left", *marks])

    return docs.select("node", "text").mapInArrow(run, "node long, ids binary, weights binary, total double, prefix array<int>, left array<double>, " + ", ".join(f"{m} long" for m in marks))


def weighted_jaccard(ids_a: np.ndarray, w_a: np.ndarray, ids_b: np.ndarray, w_b: np.ndarray) -> float:
    at = np.searchsorted(ids_b, ids_a)
    at[at == len(ids_b)] = 0
    same = ids_b[at] == ids_a if len(ids_b) else np.zeros(len(ids_a), bool)
    shared = float(np.minimum(w_a[same], w_b[at[same]]).sum(dtype=float))
    return shared / max(float(w_a.sum(dtype=float)) + float(w_b.sum(dtype=float)) - shared, 1e-30)


def verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows of pairs (a, b and whatever longs besides) whose weighted Jaccard similarity is at least `least`."""
    one = sets.select(F.col("node").alias("a"), F.col("ids").alias("ids_a"), F.col("weights").alias("w_a"))
    two = sets.select(F.col("node").alias("b"), F.col("ids").alias("ids_b"), F.col("weights").alias("w_b"))
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, v, y, w) in enumerate(zip(*(batch.column(c) for c in ("ids_a", "w_a", "ids_b", "w_b")))):
                sets_of = ((x, np.uint32), (v, np.float32), (y, np.uint32), (w, np.float32))
                if weighted_jaccard(*(np.frombuffer(c.as_buffer(), t) for c, t in sets_of)) >= least:
                    keep.append(i)
            yield batch.select(names).take(pa.array(keep, pa.int64()))

    schema = ", ".join(f"{c} long" for c in names)
    return pairs.join(two, "b").join(one, "a").select(*names, "ids_a", "w_a", "ids_b", "w_b").mapInArrow(run, schema)


def stars(work: Workspace, texts: DataFrame) -> DataFrame:
    """(a, b): each text that shares a bucket with others, beside the bucket's first one."""
    buckets = texts.select("node", F.posexplode("bands").alias("band", "key"))
    by = ["band", "key"]
    # Written first, so that no step between join and shuffle asks for a bucket's rows together: a hot one can be split.
    heads = work.put(buckets.groupBy(*by).agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"), "heads")
    pairs = buckets.join(heads, by).where("a != node").select("a", F.col("node").alias("b")).distinct()
    return work.put(pairs, "stars")


def meetings(lights: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """(a, b, ra, rb): pairs of different roots that share a key, and whose totals leave them a chance there.

    Of two similar texts the lighter one, x, is light at the first shingle in common, and the other's total lies
    between its own and `most`; so members are dealt by key and by steps of their total. Where a key has a root that
    leads it, either x or y isn't of that root: all x meet the others, and the others meet the leading ones, so that a
    large component isn't held against itself. Each bit in which the bitmaps of rare shingles differ is a shingle of one
    of them that the other lacks, and so bounds their similarity. A pair that is known to meet at an earlier key as well
    is left to that one.
    """
    step = lambda c: F.floor(F.log(c) / math.log(STEP)).cast("int")
    low = step(F.col("total") * (1 - EDGE))
    steps = F.explode(F.sequence(low, F.greatest(low, step(F.col("most"))))).alias("step")
    marks = [f"mark{i}" for i in range(MARKS)]
    named = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "total", "most", "before", *marks)]
    leads = F.coalesce(F.col("root") == F.col("lead"), F.lit(False))
    sides = F.when(F.col("lead").isNull() | leads, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    x = lights.select("key", *named("x"), F.col("total"), F.col("most"), sides.alias("sides")).select("*", steps).drop("total", "most")
    x = x.withColumn("side", F.explode("sides")).drop("sides")
    y = members.select("key", *named("y"), step(F.col("total")).alias("step"), leads.cast("int").alias("side"))
    c = F.col
    fits = (c("root_x") != c("root_y")) & (c("total_y") >= c("total_x") * (1 - EDGE)) & (c("total_y") <= c("most_x")) & (c("total_x") <= c("most_y"))
    apart = sum((F.bit_count(c(f"{m}_x").bitwiseXOR(c(f"{m}_y"))) for m in marks), F.lit(0))
    fits &= apart * RARE <= (c("total_x") + c("total_y")) * ((1 - least) / (1 + least) * (1 + EDGE))
    met = x.join(y, ["key", "step", "side"]).where(fits & ~F.arrays_overlap("before_x", "before_y"))
    pick = lambda name, one, other: F.when(c("node_x") < c("node_y"), c(f"{name}_{one}")).otherwise(c(f"{name}_{other}"))
    return met.select(pick("node", "x", "y").alias("a"), pick("node", "y", "x").alias("b"), pick("root", "x", "y").alias("ra"), pick("root", "y", "x").alias("rb")).distinct()


def crossing_keys(tokens: DataFrame, dense: int | None) -> DataFrame:
    """Keys that hold pairs of a light member and one of another root, the root that leads a large one, and whether such
    pairs are over `dense` for each member."""
    light = F.col("most") >= F.col("total") * (1 - EDGE)
    by_root = tokens.groupBy("key", "root").agg(F.count("*").cast("double").alias("n"), F.count_if(light).cast("double").alias("lights"))
    n, lights, within = F.sum("n"), F.sum("lights"), F.sum(F.col("n") * F.col("lights"))
    held = by_root.groupBy("key").agg((n * lights - within).alias("pairs"), n.alias("held"), F.max_by("root", F.struct("n", "root")).alias("lead")).where("pairs > 0")
    heavy = F.lit(False) if dense is None else F.col("pairs") > dense * F.col("held")
    return held.select("key", F.when(F.col("held") > LEAD, F.col("lead")).alias("lead"), heavy.alias("heavy"))


def crossings(work: Workspace, sets: DataFrame, roots: DataFrame, least: float, dense: int) -> DataFrame:
    """(node, root): where the roots of linked texts lead in the end.

    Keys with few pairs of different roots meet once. Those with many go through rounds: at first one text in SHARES
    meets a few members of each component, then all do. Only they are read again, under their new roots.
    """
    marks = [f"mark{i}" for i in range(MARKS)]
    held = sets.select("node", "total", "prefix", "left", *marks).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # The greatest total that a similar text can have, if this is the first shingle in common.
    most = F.col("at.left") * ((1 + least) / least) * (1 + EDGE) - F.col("total")
    tokens = held.select("node", "root", "total", F.posexplode(F.arrays_zip("prefix", "left")).alias("pos", "at"))
    tokens = work.put(tokens.select("node", "root", "total", "pos", F.col("at.prefix").alias("key"), most.alias("most")), "prefixes")
    keys = work.put(crossing_keys(tokens, dense), "keys")
    # One row for each text, with those of its prefix that meet others, in order.
    own = F.array_sort(F.collect_list(F.struct("pos", "key", "most", "lead", "heavy"))).alias("t")
    texts = tokens.join(keys, "key").groupBy("node").agg(own).join(held.select("node", "root", "total", *marks), "node")
    texts = work.put(texts, "texts")
    work.drop(tokens, keys)
    light = F.col("most") >= F.col("total") * (1 - EDGE)
    sampled = lambda share: F.pmod(F.xxhash64("node"), F.lit(share)) == 0
    parts = ["key", "node", "root", "total", "most", "lead", "before", *marks]
    edges: DataFrame | None = None
    for i, share in enumerate((*SHARES, None)):
        first = F.transform("t", lambda e: e["key"])
        members = texts.select("node", "root", "total", *marks, F.slice(first, 1, BEFORE).alias("first"), F.posexplode("t").alias("i", "e"))
        members = members.select("node", "root", "total", *marks, "e.*", F.slice("first", F.lit(1), F.least("i", F.lit(BEFORE))).alias("before"))
        if i:
            # Keys that were met before are left; roots and what is heavy have changed.
            members = members.where("heavy").drop("lead", "heavy")
            keys = work.put(crossing_keys(members.select("key", "node", "root", "total", "most"), None if share is None else dense), "keys")
            members = members.join(keys, "key")
        lights, others = members.where(light), members
        if share is not None:
            pick = F.min(F.struct(*[c for c in parts if c not in ("key", "root")])).alias("m")
            few = members.where("heavy").groupBy("key", "root", F.pmod(F.xxhash64("node", F.lit(share)), F.lit(DELEGATES))).agg(pick)
            others = members.where("not heavy").select(parts).unionByName(few.select("key", "root", "m.*").select(parts))
            lights = lights.where(~F.col("heavy") | sampled(share))
        links = work.put(verify(meetings(lights.select(parts), others.select(parts), least), sets, least), "crossings")
        links = links.select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = links if edges is None else edges.union(links)
        if share is None or texts.where(F.exists("t", lambda e: e["heavy"])).isEmpty():
            break
        now = components(work, edges.distinct()).select(F.col("node").alias("root"), F.col("root").alias("now"))
        left = texts.where(F.exists("t", lambda e: e["heavy"])).join(now, "root", "left").withColumn("root", F.coalesce("now", "root")).drop("now")
        left = work.put(left, "heavy-texts")
        work.drop(texts)
        texts = left
    return components(work, edges.distinct())


def _judged(docs: DataFrame, least: float, dense: int) -> DataFrame:
    """doc_id, h1, h2, component_id, n_copies, kept of each row."""
    spark = docs.sparkSession
    work = Workspace(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    idf = spark.sparkContext.broadcast(frequency_table(docs))
    rows = work.put(signatures(docs, idf), "signatures")
    # A text goes by the number of the row that has its least doc_id; one doc_id may have several texts.
    first = F.min(F.struct("doc_id", "row")).alias("f")
    texts = rows.where("doc_id is not null").groupBy("h1", "h2").agg(first, F.count("*").alias("n_copies"), F.first("bands").alias("bands"))
    texts = work.put(texts.select("h1", "h2", F.col("f.doc_id").alias("rep"), F.col("f.row").alias("node"), "n_copies", "bands"), "texts")
    pairs = stars(work, texts)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    nodes = nodes.join(texts.select("node", F.col("rep").alias("doc_id"), "h1", "h2"), "node")
    own = ["doc_id", "h1", "h2"]
    found = docs.select("*", *text_keys()).join(nodes.hint("shuffle_hash"), own).dropDuplicates(own)
    sets = work.put(weighted_sets(found, idf, least), "sets")
    alike = work.put(verify(pairs, sets, least), "alike")
    roots = components(work, alike)
    classes = texts.select("h1", "h2", "rep", "node", "n_copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    onward = crossings(work, sets, roots, least, dense).select(F.col("node").alias("root"), F.col("root").alias("now"))
    classes = classes.join(onward, "root", "left").withColumn("root", F.coalesce("now", "root")).drop("now")
    classes = work.put(classes, "classes")
    work.only(rows, classes)
    top = classes.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("top"))
    classes = classes.join(top, "root").select("h1", "h2", "n_copies", F.col("top.rep").alias("component_id"), F.col("top.node").alias("best"))
    out = rows.select("doc_id", "h1", "h2", "row").join(classes, ["h1", "h2"], "left")
    some = F.col("doc_id").isNotNull()
    best = F.coalesce(F.col("row") == F.col("best"), F.lit(False))
    return out.select("doc_id", "h1", "h2", F.when(some, F.col("component_id")).alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), (~some | best).alias("kept"))


def deduplicate(docs: DataFrame, *, least: float = 0.8, dense: int = DENSE) -> DataFrame:
    """doc_id, component_id, n_copies, kept: one row per row of docs.

    Rows of one component are linked by equal texts or by weighted similarities of at least `least`;
    `component_id` is its smallest doc_id, of which one row alone is kept; `n_copies` counts the rows of the same
    text. Rows are told apart by their texts, also where they have one doc_id. Null is as the empty text, and empty
    texts equal each other; a text without words has no other links. A null doc_id is a component of its own.
    Texts of any length are compared whole; an empty table gives an empty result. Columns besides doc_id and text are
    not read.
    """
    return _judged(docs, least, dense).select("doc_id", "component_id", "n_copies", "kept")


def without_copies(docs: DataFrame, *, least: float = 0.8, dense: int = DENSE) -> DataFrame:
    """The rows of docs that `deduplicate` keeps, one of each component, with all columns, whatever their names."""
    work = Workspace(docs.sparkSession, "near")
    id_, h1, h2 = names = fresh_names(docs, "id", "h1", "h2")
    kept = _judged(docs, least, dense).where("kept and doc_id is not null")
    kept = work.put(kept.select(F.col("doc_id").alias(id_), F.col("h1").alias(h1), F.col("h2").alias(h2)), "kept")
    rows = docs.withColumns({id_: F.col("doc_id").cast("long"), **dict(zip((h1, h2), text_keys()))})
    # Of a repeated row all come up to here.
    once = rows.join(kept, names, "left_semi").dropDuplicates(names)
    return once.select(*docs.columns).unionByName(docs.where("doc_id is null"))
