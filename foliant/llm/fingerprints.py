"""Fingerprints by a randomised edit embedding.

A text is read by walks that all texts share: in each step a walk writes the character it stands at, and a random function
of step and character says whether it goes on to the next. Texts that differ by few edits soon stand at the same
characters in the same steps again, so their edit distance becomes a Hamming distance of what was written. A fingerprint
samples the steps, the same ones for all texts of a length: those whose hash has many zeros, as many zeros as leave at most
SAMPLES. Sampled steps in groups are the keys of bands in which candidates meet, and edit distances verify them.

The functions of the steps have a period of PERIOD, so that all positions of a block can go PERIOD steps at once: jumps
are doubled, each walk is followed in long jumps, and these are filled up again, all with whole arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliant.llm.graph import components, text_keys
from foliant.llm.kernels import U, mix, powers
from foliant.workspace import Workspace, small_batches

WALKS, PERIOD, SAMPLES = 2, 32, 256
#: Characters that are walked at a time; longer texts go on where the last part ended.
PART = 1 << 17
#: Bands of a walk; each has the sampled steps that a hash gives it, from all over the text.
BANDS = 8
#: Each edit changes so many grams of a text at most, and as many new ones come.
GRAM = 4


def _balanced_masks(seed: int, classes: int = 1024) -> np.ndarray:
    """For each class of characters the steps of a period in which the walk goes on: half of them."""
    order = np.random.default_rng(seed).random((classes, PERIOD)).argsort(axis=1)
    return ((order < PERIOD // 2) << np.arange(PERIOD)).sum(axis=1).astype(np.uint32)


MASKS = [_balanced_masks(41 + w) for w in range(WALKS)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A class of ten bits and a symbol of eight for each character."""
    h = mix(points.astype(U) + U(0x51ED27))
    return (h >> U(54)).astype(np.int64), (h & U(255)).astype(np.uint8)


def _masked(a: np.ndarray, b: np.ndarray, far: int) -> np.ndarray:
    """a + b[at + a], where a is at most `far` and no walk leaves its part."""
    out = a + b * (a == 0)
    for k in range(1, far + 1):
        out[:-k] += b[k:] * (a[:-k] == k)
    return out


def _arrivals_of_parts(steps: np.ndarray, first: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """For each character when the walk reaches it, in steps from its part's start.

    steps has for each character the period's steps in which the walk goes on, and 0 at the end of a part: there it stays.
    first are the parts' starts (parts + 1), phase the step of the period in which each begins.
    """
    n, parts = len(steps), len(first) - 1
    arrival = np.zeros(n, np.int64)
    at = np.arange(n)
    bits = [((steps >> np.uint32(s)) & np.uint32(1)).astype(np.uint8) for s in range(PERIOD)]
    here = first[:-1].copy()
    # Up to the start of the next period.
    for s in range(int(phase.min(initial=PERIOD)), PERIOD):
        goes = np.flatnonzero((phase <= s) & (bits[s][here] > 0))
        here[goes] += 1
        arrival[here[goes]] = s + 1 - phase[goes]
    # How far a walk goes in 2, 4, ... steps of a period from each position; few ways are told apart by masks.
    hops, far = bits, 1
    while len(hops) > 1:
        pairs = zip(hops[::2], hops[1::2])
        hops = [_masked(a, b, far) if far <= 4 else a + b[at + a] for a, b in pairs]
        far *= 2
    jumps = [at + hops[0]]
    ends = first[1:] - 1
    longest = int(np.diff(first).max(initial=1))
    while (longest * 2 // PERIOD) >> (len(jumps) - 1) > 256:
        jumps.append(jumps[-1][jumps[-1]])
    # The places of all walks at multiples of the longest jump, then of half of it, down to a period.
    path = [here]
    while (here < ends).any():
        here = jumps[-1][here]
        path.append(here)
    places = np.array(path)
    for jump in jumps[-2::-1]:
        both = np.empty((2 * len(places), parts), np.int64)
        both[::2], both[1::2] = places, jump[places]
        places = both
    # Each step of the periods in which a walk isn't at its end.
    period, part = np.nonzero(places < ends[None, :])
    here, start = places[period, part], (period + 1) * PERIOD - phase[part]
    for s in range(PERIOD):
        goes = np.flatnonzero(bits[s][here])
        here[goes] += 1
        arrival[here[goes]] = start[goes] + s + 1
    return arrival


def arrivals(classes: list[np.ndarray], begin: list[int], masks: np.ndarray) -> list[np.ndarray]:
    """For each text when the walk, which begins in the given step, reaches each character and the end (chars + 1)."""
    out = [np.full(1, b, np.int64) for b in begin]
    for k in range(0, max((len(c) for c in classes), default=0), PART):
        some = [i for i, c in enumerate(classes) if len(c) > k]
        parts = [classes[i][k : k + PART] for i in some]
        first = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        steps = np.zeros(first[-1], np.uint32)
        inner = np.ones(first[-1], bool)
        inner[first[1:] - 1] = False
        steps[inner] = masks[np.concatenate(parts)]
        from_ = np.array([out[i][-1] for i in some])
        reached = _arrivals_of_parts(steps, first, from_ % PERIOD)
        for j, i in enumerate(some):
            out[i] = np.concatenate([out[i], from_[j] + reached[first[j] + 1 : first[j + 1]]])
    return out


class Sampled:
    """The steps of each level: those whose hash ends in as many zeros at least. Levels are nested."""

    def __init__(self):
        self.zeros = np.zeros(0, np.uint8)
        self.levels: list[np.ndarray] = []
        self.most = np.zeros(0, np.int64)  # for each level the greatest length with at most SAMPLES steps

    def __call__(self, length: int) -> tuple[int, np.ndarray]:
        """The lowest level with at most SAMPLES steps before `length`, and these."""
        if not self.levels or len(self.zeros) < length:
            h = mix(np.arange(1, max(2 * length, 1 << 16) + 1, dtype=U))
            self.zeros = np.bitwise_count((h & (~h + U(1))) - U(1)).astype(np.uint8)
            self.levels = [np.flatnonzero(self.zeros >= z) for z in range(64)]
            self.most = np.array([held[SAMPLES] if len(held) > SAMPLES else len(self.zeros) for held in self.levels])
        level = int(np.searchsorted(self.most, length))
        steps = self.levels[level]
        return level, steps[: np.searchsorted(steps, length)]


SAMPLED = Sampled()


def written(symbols: np.ndarray, reached: np.ndarray) -> tuple[int, bytes]:
    """Steps of a walk, and what it wrote in the sampled ones."""
    length = int(reached[-1])
    _, steps = SAMPLED(length)
    return length, symbols[np.searchsorted(reached, steps, "right") - 1].tobytes()


def shown(walks: list[tuple[int, bytes]]) -> str:
    return "-".join(f"{length:x}:{held.hex()}" for length, held in walks)


def parsed(fingerprint: str) -> list[tuple[int, bytes]]:
    parts = (w.split(":") for w in fingerprint.split("-"))
    return [(int(length, 16), bytes.fromhex(held)) for length, held in parts]


def likeness(one: list[tuple[int, bytes]], other: list[tuple[int, bytes]]) -> float:
    """The greatest share, among the walks, of sampled steps in which both wrote the same symbol; 1 for two empty texts."""
    best = 0.0
    for (m, a), (n, b) in zip(one, other):
        if m == n:
            best = max(best, float(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8))) if a else 1.0)
            continue
        if m > n:
            m, a, n, b = n, b, m, a
        level, steps = SAMPLED(n)
        _, held = SAMPLED(m)
        both = SAMPLED.zeros[held] >= level
        # The steps of the longer text's level before the shorter one's end are the first of its own.
        short = np.frombuffer(a, np.uint8)[both]
        if len(steps):
            best = max(best, float((short == np.frombuffer(b, np.uint8)[: len(short)]).sum()) / len(steps))
    return best


class Walked:
    """Texts with their walks: fingerprints, and those of texts that begin alike."""

    def __init__(self, points: list[np.ndarray]):
        self.points = points
        flat, sym = classes_of(np.concatenate([*points, np.zeros(0, np.uint32)]))
        cut = np.cumsum([len(p) for p in points])[:-1]
        self.classes, self.symbols = np.split(flat, cut), np.split(sym, cut)
        none = [0] * len(points)
        self.reached = [arrivals(self.classes, none, masks) for masks in MASKS]

    def fingerprints(self) -> list[list[tuple[int, bytes]]]:
        return [[written(s, r[i]) for r in self.reached] for i, s in enumerate(self.symbols)]

    def joined(self, head: list[int], tail: list[np.ndarray]) -> list[list[tuple[int, bytes]]]:
        """Fingerprints of each text's first characters, so many, with other ones behind them."""
        flat, sym = classes_of(np.concatenate([*tail, np.zeros(0, np.uint32)]))
        cut = np.cumsum([len(p) for p in tail])[:-1]
        classes, symbols = np.split(flat, cut), np.split(sym, cut)
        out: list[list[tuple[int, bytes]]] = [[] for _ in tail]
        for reached, masks in zip(self.reached, MASKS):
            begin = [int(reached[i][h]) for i, h in enumerate(head)]
            for i, more in enumerate(arrivals(classes, begin, masks)):
                whole = np.concatenate([reached[i][: head[i]], more])
                out[i].append(written(np.concatenate([self.symbols[i][: head[i]], symbols[i]]), whole))
        return out


def grouped(rows: Iterator[tuple], size, most: int) -> Iterator[list[tuple]]:
    """Consecutive rows in lists of about `most` in size, never less than a row."""
    held, total = [], 0
    for row in rows:
        if held and total + size(row) > most:
            yield held
            held, total = [], 0
        held.append(row)
        total += size(row)
    if held:
        yield held


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_RESULT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(rows: list[tuple[int | None, str]], following: list[str]) -> pa.RecordBatch:
    """The results of rows (doc_id, text), each with the text of the document that follows."""
    texts = [t for _, t in rows]
    place = {t: i for i, t in reversed(list(enumerate(texts)))}
    more = [t for t in dict.fromkeys(following) if t not in place]
    place |= {t: len(texts) + i for i, t in enumerate(more)}
    walked = Walked([code_points(t) for t in (*texts, *more)])
    prints = walked.fingerprints()
    halves = [len(t) // 2 for t in texts]
    head = [len(t) - h for t, h in zip(texts, halves)]
    tail = [walked.points[place[f]][:h] for f, h in zip(following, halves)]
    edited = walked.joined(head, tail)
    digests = [hashlib.sha256((t[:k] + f[:h]).encode("utf-8", "surrogatepass")).hexdigest() for t, k, f, h in zip(texts, head, following, halves)]
    own = prints[: len(texts)]
    columns = [
        [i for i, _ in rows], [len(t) for t in texts], digests, [shown(p) for p in own], [shown(p) for p in edited],
        [likeness(a, b) for a, b in zip(own, edited)], [likeness(a, prints[place[f]]) for a, f in zip(own, following)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)


def id_ranges(docs: DataFrame, count: int) -> tuple[list[int], list[int]]:
    """Bounds that part doc_ids into about `count` ranges, and the least id of each range from the first on.

    A number of rows that only depends on `count` comes to the driver.
    """
    shares = [i / count for i in range(1, count)]
    ids = docs.where("doc_id is not null")
    found = ids.select(F.percentile_approx("doc_id", shares, 10 * count).alias("b")).first()["b"] if shares else []
    bounds = sorted(set(found or []))
    least = ids.groupBy(range_of(F.col("doc_id"), bounds).alias("at")).agg(F.min("doc_id").alias("low"))
    lows = {r["at"]: r["low"] for r in least.collect()}
    # Only ranges with rows are left: each begins with an id that occurs.
    starts = [lows[k] for k in sorted(lows)]
    return starts[1:], starts


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds a value reaches, by two short scans."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[::step]
    array = lambda held: F.array(*map(F.lit, held)).cast("array<long>") if held else F.array().cast("array<long>")
    reached = lambda held: F.size(F.filter(held, lambda b: b <= value))
    blocks = reached(array(coarse))
    inside = reached(F.slice(array(bounds), F.greatest(blocks - 1, F.lit(0)) * step + 1, step))
    return F.when(blocks == 0, 0).otherwise((blocks - 1) * step + inside)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row.

    A document's edited text is its own, with the last half of its code points replaced by as many, or all, of the
    document that follows by doc_id; the last is followed by the first, a single one by itself. Of rows with one doc_id
    the hash of their texts tells the order, and repeated rows follow each other. Null is the empty text. Rows without
    a doc_id have no place in that order: the empty text follows them, and they follow none. Texts of any length are
    read whole; of two empty texts the likeness is 1, of an empty one and another 0. An empty table gives an empty
    result. Columns besides doc_id and text are not read.

    Texts are dealt once, by ranges of their ids; the first id of each range is sent to the range before as well.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lone = rows.where("doc_id is null")
    placed = rows.where("doc_id is not null")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, starts = id_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id")), count)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for held in grouped(rows, lambda r: len(r[1]) + 64, PART):
            yield edited_pairs(held, [""] * len(held))

    out = lone.mapInArrow(alone, _RESULT_SQL)
    if not starts:
        return out
    at = range_of(F.col("doc_id"), bounds)
    first = F.get(F.array(*map(F.lit, starts)).cast("array<long>"), at) == F.col("doc_id")
    stay = F.struct(at.alias("at"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(at - 1, F.lit(len(starts))).alias("at"), F.lit(True).alias("guest"))
    dealt = placed.select(F.explode(F.when(first, F.array(stay, before)).otherwise(F.array(stay))).alias("to"), "doc_id", "text")
    dealt = dealt.select("to.at", "to.guest", "doc_id", "text", F.xxhash64("text").alias("h"))
    dealt = dealt.repartitionById(count, "at").sortWithinPartitions("at", "guest", "doc_id", "h").select("at", "guest", "doc_id", "text")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            last = None
            for b in batches:
                for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                    if last is not None and last[0] == row[0] and not last[1]:
                        yield (last[2], last[3], row[3])
                    last = row

        for held in grouped(pairs(), lambda r: len(r[1]) + 64, PART):
            yield edited_pairs([(i, t) for i, t, _ in held], [f for _, _, f in held])

    return dealt.mapInArrow(follow, _RESULT_SQL).unionByName(out)


def band_keys(prints: list[tuple[int, bytes]]) -> np.ndarray:
    """Keys of the bands of all walks, in the fingerprint's level and the next one, as lengths of near texts may lie on both sides of a change."""
    keys = []
    for walk, (length, held) in enumerate(prints):
        level, steps = SAMPLED(length)
        symbols = np.frombuffer(held, np.uint8).astype(U)
        for up in (level, level + 1):
            some = SAMPLED.zeros[steps] >= up
            at = steps[some].astype(U)
            band = (mix(at * U(0x2545F491) + U(7)) % U(BANDS)).astype(np.int64)
            sums = np.zeros(BANDS, U)
            np.add.at(sums, band, mix(at << U(8) | symbols[some]))
            keys.append(mix(sums ^ mix(np.arange(BANDS, dtype=U) + U((up * WALKS + walk) * BANDS)))[np.unique(band)])
    return np.concatenate(keys).view(np.int64)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two arrays if it is at most `most`: the furthest reach on each diagonal, with hashes for equal stretches."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    power, inverse = powers(max(n, m) + 1)
    sums = [np.concatenate([[U(0)], np.cumsum(mix(x.astype(U) + U(1)) * power[: len(x)], dtype=U)]) for x in (a, b)]

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many elements from a[i] and b[j] on are equal."""
        room, done = np.minimum(n - i, m - j), np.zeros(len(i), np.int64)
        for bit in reversed(range(int(room.max(initial=0)).bit_length())):
            to = done + (1 << bit)
            some = np.flatnonzero(to <= room)
            x, y, t = i[some], j[some], to[some]
            same = (sums[0][x + t] - sums[0][x]) * inverse[x] == (sums[1][y + t] - sums[1][y]) * inverse[y]
            done[some[same]] = t[same]
        return done

    never = -(n + m + 2)
    at = np.zeros(1, np.int64)
    for edits in range(most + 1):
        # The furthest place in a on each diagonal, from those that one edit less reached.
        diagonal = np.arange(-edits, edits + 1)
        if edits:
            wide = np.concatenate([[never, never], at, [never, never]])
            at = np.maximum(np.maximum(wide[1:-1] + 1, wide[:-2]), wide[2:] + 1)
        at = np.minimum(at, np.minimum(n, m - diagonal))
        valid = np.flatnonzero((at >= 0) & (at + diagonal >= 0))
        at[valid] += alike(at[valid], at[valid] + diagonal[valid])
        at[np.setdiff1d(np.arange(len(at)), valid)] = never
        if abs(m - n) <= edits and at[m - n + edits] == n:
            return edits
    return None


def _grams(points: np.ndarray) -> np.ndarray:
    """How often each of 2**16 buckets of grams occurs."""
    h = np.zeros(max(0, len(points) - GRAM + 1), U)
    for i in range(GRAM):
        h = h * U(0xD6E8FEB86659FD93) + points[i : i + len(h)].astype(U)
    return np.bincount((mix(h) & U(0xFFFF)).astype(np.int64), minlength=1 << 16)


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance is at most `most`; grams tell most of those apart that are far."""
    if abs(len(a) - len(b)) > most or np.abs(_grams(a) - _grams(b)).sum() > 2 * GRAM * most:
        return False
    return edit_distance(a, b, most) is not None


def close_pairs(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts' edit distance is at most 1 - least of the longer one's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if within(code_points(x), code_points(y), int((1 - least) * max(len(x), len(y)) + 1e-9)):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    one, two = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_texts(docs: DataFrame, *, least: float = 0.9) -> DataFrame:
    """doc_id, component_id, n_copies, kept: classes of texts that few edits lead to each other, one row per row of docs.

    Texts are linked if they are equal, or share a band of sampled steps and their edit distance is at most 1 - least of
    the longer one's code points. In a bucket all are held against the first one, and what is then still of different
    components in pairs. `component_id` is the least doc_id of a class, of which the rows with it are kept; `n_copies`
    counts the rows of the same text. Null is the empty text. A row without a doc_id is kept and has no links. Bands
    find a pair with a probability that falls with its edits; links that no band finds are missed.
    """
    work = Workspace(docs.sparkSession, "fingerprints")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "text", *text_keys())

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4))))
        for held in grouped(stream, lambda r: len(r[1]) + 64, PART):
            keys = [band_keys(p).tolist() for p in Walked([code_points(t) for _, t, *_ in held]).fingerprints()]
            columns = [[r[0] for r in held], [r[2] for r in held], [r[3] for r in held], keys]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["doc_id", "h1", "h2", "keys"])

    signed = work.put(keyed.where("doc_id is not null").mapInArrow(banded, "doc_id long, h1 long, h2 long, keys array<long>"), "signed")
    own = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("keys").alias("keys"))
    own = work.put(own.withColumn("node", F.monotonically_increasing_id()), "texts")
    members = own.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    heads = work.put(members.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"), "heads")
    members = work.put(members.join(heads, "key"), "members")
    stars = members.where("a != node").select("a", F.col("node").alias("b")).distinct()
    met = members.select("node").distinct().join(own, "node").select("node", "h1", "h2", F.col("rep").alias("doc_id"))
    texts = keyed.where("doc_id is not null").join(met.hint("shuffle_hash"), ["doc_id", "h1", "h2"]).dropDuplicates(["node"]).select("node", "text")
    texts = work.put(texts, "met")
    links = work.put(close_pairs(stars, texts, least), "stars")
    roots = components(work, links)
    held = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    held = work.put(held.join(mixed, "key"), "mixed")
    x, y = (held.select("key", F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
    pairs = x.join(y, "key").where("a < b and root_a != root_b").select("a", "b").distinct()
    links = work.put(links.union(close_pairs(pairs.join(stars, ["a", "b"], "left_anti"), texts, least)), "links")
    classes = own.join(components(work, links), "node", "left").select("h1", "h2", "rep", "n_copies", F.coalesce("root", "node").alias("root"))
    least_id = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = work.put(classes.join(least_id, "root").select("h1", "h2", "n_copies", "component_id"), "classes")
    out = keyed.drop("text").join(classes, ["h1", "h2"], "left")
    some = F.col("doc_id").isNotNull()
    kept = ~some | (F.col("doc_id") == F.col("component_id"))
    return out.select("doc_id", F.when(some, F.col("component_id")).alias("component_id"), F.when(some, F.col("n_copies")).otherwise(1).alias("n_copies"), kept.alias("kept"))
