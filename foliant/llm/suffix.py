"""Removal of every byte covered by a string of 400 bytes that starts anywhere else as well.

Suffixes are sorted around anchors: the 64-byte strings of least hash in each window of 400 bytes, so that equal
windows hold an equal anchor at an equal place. Anchors that occur once settle all their windows. For the others,
the bytes after the anchor and, reversed, those before it are sorted by deep-shallow sorting: multikey quicksort
to a shallow depth, then a blind trie for each group that is still tied. The common prefixes of neighbours in the
two orders tell, for every place of the anchor in a window, which windows are equal, byte for byte.

An anchor with more than HOT occurrences (a passage that very many documents share) isn't sorted in one task. Its
windows are split by their offset into pieces of STEP, and pieces by the bytes that their windows have in common;
where all occurrences of a piece are alike, or only one is left, that settles it, and counts are gathered before the
shuffle. What remains, at the edges of such passages, is settled window by window. Both go by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from foliant.llm.graph import fresh_names, text_keys
from foliant.llm.kernels import U, Block, blocks, mix, powers
from foliant.workspace import Workspace

WINDOW, ANCHOR = 400, 64
SEGMENT = 1 << 20
SHALLOW = 32
#: Occurrences of an anchor beyond which its windows are split among tasks; rows sorted at a time.
HOT, ROWS = 8192, 4096
STEP = 16


def anchors(block: Block, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(row, position in the row, hash, least and greatest offset) of each anchor and its run of windows."""
    data, offsets = block.data, block.offsets
    prefix, (_, inverse) = block.prefix(), powers(len(data) + 1)
    n, w = len(data) - window + 1, window - anchor + 1
    found: list[tuple[np.ndarray, ...]] = []
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = mix((prefix[anchor:] - prefix[:-anchor]) * inverse[: len(prefix) - anchor])
    row = np.searchsorted(offsets, np.arange(n), "right") - 1
    inside = np.arange(n) + window <= offsets[row + 1]
    for at in range(0, n, SEGMENT):
        to = min(n, at + SEGMENT)
        part = (grams[at : to + w - 1] & ~U(0xFFFFFF)) | np.arange(to - at + w - 1, dtype=U)
        padded = np.concatenate([part, np.full(-len(part) % w, ~U(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(back[: to - at], ahead[w - 1 : w - 1 + to - at]) & U(0xFFFFFF)).astype(np.int64) + at
        starts = np.flatnonzero(inside[at:to]) + at
        if not len(starts):
            continue
        chosen = least[starts - at]
        new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (row[starts[1:]] != row[starts[:-1]])]))
        last = np.concatenate([new[1:], [len(starts)]]) - 1
        where = chosen[new]
        found.append((row[starts[new]], where - offsets[row[starts[new]]], grams[where].view(np.int64), where - starts[last], where - starts[new]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(5))


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to reach `at`."""
    n, step = min(len(a), len(b)), 32
    while at < n:
        to = min(n, at + step)
        if a[at:to] != b[at:to]:
            while a[at] == b[at]:
                at += 1
            return at
        at, step = to, step * 2
    return n


class BlindTrie:
    """Patricia trie over branching places only: a descent looks at no other byte, one comparison then tells the place."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: tuple | int = first  # a leaf, or [depth, {byte or -1: node}]

    def add(self, one: int, depth: int) -> None:
        text = self.strings[one]
        node = self.root
        while not isinstance(node, int):
            branch = text[node[0]] if node[0] < len(text) else -1
            node = node[1].get(branch, next(iter(node[1].values())))
        leaf = self.strings[node]
        shared = common(text, leaf, depth)
        mine = text[shared] if shared < len(text) else -1
        theirs = leaf[shared] if shared < len(leaf) else -1
        above, node = None, self.root
        while not isinstance(node, int) and node[0] < shared:
            above, node = node, node[1][text[node[0]]]
        if not isinstance(node, int) and node[0] == shared:
            node[1][mine] = one
            return
        made = [shared, {theirs: node, mine: one}]
        if above is None:
            self.root = made
        else:
            above[1][text[above[0]]] = made

    def walk(self, depth: int) -> Iterator[tuple[int, int]]:
        """(string, common prefix with the one before) in order; `depth` for the first."""
        stack: list[tuple[tuple | int, int]] = [(self.root, depth)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, int):
                yield node, shared
            else:
                branches = sorted(node[1])
                for i, b in enumerate(reversed(branches)):
                    stack.append((node[1][b], shared if i == len(branches) - 1 else node[0]))


def deep_shallow(strings: list[bytes], members: list[int], depth: int, shallow: int = SHALLOW) -> list[tuple[int, int]]:
    """Members, distinct strings that agree to `depth`, in order, with the common prefix of each and the one before."""
    out: list[tuple[int, int]] = []
    limit = depth + shallow
    stack: list[tuple[list[int], int, int]] = [(members, depth, depth)]
    while stack:
        tied, at, shared = stack.pop()
        if len(tied) == 1:
            out.append((tied[0], shared))
        elif at >= limit:
            trie = BlindTrie(strings, tied[0])
            for one in tied[1:]:
                trie.add(one, at)
            out += trie.walk(shared)
        else:
            key = lambda i: strings[i][at] if at < len(strings[i]) else -1  # noqa: B023, E731
            keys = [key(i) for i in tied]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            parts = ([], [], [])
            for i, k in zip(tied, keys):
                parts[(k > pivot) + (k >= pivot)].append(i)
            pending = []
            for part, next_at in zip(parts, (at, at + 1, at)):
                if part:
                    pending.append((part, next_at, shared))
                    shared = at
            stack += reversed(pending)
    return out


def _orders(strings: list[bytes], groups: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string its place in the order of groups and strings; for each place the common prefix with the one before.

    Equal strings of a group are neighbours with their whole length in common. groups are sorted.
    """
    place, shared = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int32)
    cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])), [len(groups)]])
    at = 0
    for a, b in zip(cuts, cuts[1:]):
        same: dict[bytes, list[int]] = {}
        for i in range(a, b):
            same.setdefault(strings[i], []).append(i)
        order = deep_shallow(strings, [v[0] for v in same.values()], depth)
        first = True
        for one, lcp in order:
            for i in same[strings[one]]:
                place[i], shared[at] = at, -1 if first else lcp
                lcp, first = len(strings[one]), False
                at += 1
    return place, shared


def equal_windows(keys: np.ndarray, before: list[bytes], after: list[bytes], low: np.ndarray, high: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(occurrence, from, to): offsets of the anchor at which an occurrence's window equals another's. keys are sorted."""
    left_at, left = _orders([x[::-1] for x in before], keys, 0)
    right_at, right = _orders(after, keys, anchor)
    n = len(keys)
    was = np.full(n, -1, np.int32)
    for o in range(window - anchor + 2):
        now = np.zeros(n, bool)
        active = np.flatnonzero((low <= o) & (o <= high))
        if len(active):
            one = np.cumsum(left < o)[left_at[active]] * np.int64(n + 1) + np.cumsum(right < window - o)[right_at[active]]
            order = np.argsort(one, kind="stable")
            twin = one[order][1:] == one[order][:-1]
            now[active[order[1:][twin]]] = True
            now[active[order[:-1][twin]]] = True
        ended = np.flatnonzero((was >= 0) & ~now)
        if len(ended):
            yield ended, was[ended], np.full(len(ended), o - 1, np.int32)
            was[ended] = -1
        was[now & (was < 0)] = o


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    """Tables of about `rows` rows of batches sorted by their first column, never parting equal keys."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if n >= rows and batch.num_rows:
            keys = batch.column(0).to_numpy()
            same = int(np.searchsorted(keys, held[-1].column(0)[-1].as_py(), "right"))
            held.append(batch.slice(0, same))
            n += same
            if same < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            batch = batch.slice(same)
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def hot_spans(texts: DataFrame, work: Workspace, window: int, anchor: int) -> DataFrame:
    """h1, h2, start, end of the repeated windows around the hot anchors of texts(h1, h2, data, at)."""
    one = F.xxhash64("h1", "h2", "pos")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "piece", "core", "whole", "h1", "h2", "pos", "low", "high"]
        types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), *(pa.int64(),) * 2, *(pa.int32(),) * 3)
        for batch in batches:
            for h1, h2, data, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                at = at.values
                which = np.flatnonzero(at.field(4).to_numpy(zero_copy_only=False))
                if not len(which):
                    continue
                data, out = data.as_py(), []
                for key, p, low, high in zip(*(at.field(k).to_numpy()[which].tolist() for k in range(4))):
                    for piece in range(low // STEP, high // STEP + 1):
                        first, last = piece * STEP, min(piece * STEP + STEP - 1, window - anchor)
                        a, b = max(low, first), min(high, last)
                        core = xxhash.xxh3_128_digest(data[p - first : p + window - last])
                        out.append((key, piece, core, xxhash.xxh3_128_digest(data[p - b : p + window - a], a << 16 | b), h1, h2, p, a, b))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    by = ["key", "piece", "core"]
    pieces = work.put(texts.mapInArrow(split, "key long, piece int, core binary, whole binary, h1 long, h2 long, pos int, low int, high int"), "pieces")
    states = pieces.groupBy(*by).agg(F.min(one).alias("a"), F.max(one).alias("b"), (F.min("whole") == F.max("whole")).alias("alike")).where("a != b")
    pieces = work.put(pieces.join(work.put(states.select(*by, "alike"), "piece-states"), by).select("h1", "h2", "pos", "low", "high", "alike"), "shared-pieces")
    alike = pieces.where("alike").select("h1", "h2", (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + window).alias("end"))
    open_ = pieces.where("not alike").groupBy("h1", "h2").agg(F.collect_set(F.struct("pos", "low", "high")).alias("open"))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (data, held) in enumerate(zip(batch.column(2), batch.column(3))):
                data, held = data.as_py(), held.values
                starts = [p - o for p, low, high in zip(*(held.field(k).to_pylist() for k in range(3))) for o in range(low, high + 1)]
                digests = pa.array([xxhash.xxh3_128_digest(data[x : x + window]) for x in starts], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, *(pa.repeat(batch.column(c)[i], len(starts)) for c in (0, 1)), pa.array(starts, pa.int32())], ["digest", "h1", "h2", "pos"])

    left = texts.select("h1", "h2", "data").join(open_.hint("shuffle_hash"), ["h1", "h2"])
    windows = work.put(left.mapInArrow(single, "digest binary, h1 long, h2 long, pos int"), "windows")
    twice = windows.groupBy("digest").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a != b").select("digest")
    return alike.unionByName(windows.join(twice, "digest").select("h1", "h2", F.col("pos").alias("start"), (F.col("pos") + window).alias("end")))


def removed_spans(docs: DataFrame, work: Workspace, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT):
    """(rows of docs with keys and sizes, texts with something removed: h1, h2, kept, n_bytes, n_removed, n_spans)."""
    keyed = docs.select("doc_id", *text_keys(), F.coalesce("text", F.lit("")).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch):
                row, pos, key, low, high = anchors(block, window, anchor)
                if len(row):
                    taken = part.select(["h1", "h2"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(key), *taken.columns, *(pa.array(x.astype(np.int32)) for x in (pos, low, high))], ["key", "h1", "h2", "pos", "low", "high"])

    found = work.put(keyed.select("h1", "h2", "text").mapInArrow(find, "key long, h1 long, h2 long, pos int, low int, high int"), "anchors")
    # Copies of a text have its occurrences in common, so they don't count as two.
    one = F.xxhash64("h1", "h2", "pos")
    several = work.put(found.groupBy("key").agg(F.min(one).alias("a"), F.max(one).alias("b"), (F.count("*") > hot).alias("hot")).where("a != b").select("key", "hot"), "several")
    # No step between join and shuffle asks for rows of a key together, so a skewed key can be split.
    doubtful = found.join(several, "key").groupBy("h1", "h2").agg(F.collect_set(F.struct("key", "pos", "low", "high", "hot")).alias("at"))
    doubtful = work.put(doubtful, "doubtful")
    first = F.min("doc_id").alias("doc_id")
    reps = keyed.groupBy("h1", "h2").agg(first, F.count("*").alias("n_copies"))
    reps = work.put(reps, "texts")
    chosen = doubtful.join(reps.select("h1", "h2", F.col("doc_id").alias("rep")), ["h1", "h2"])
    texts = keyed.join(chosen.hint("shuffle_hash"), ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("h1", "h2", F.col("text").cast("binary").alias("data"), "at")
    texts = work.put(texts, "doubtful-texts")

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "h1", "h2", "pos", "low", "high", "before", "after"]
        for batch in batches:
            for i in range(batch.num_rows):
                data, at = batch.column(2)[i].as_py(), batch.column(3)[i].values
                at = at.filter(pc.invert(at.field(4)))
                if not len(at):
                    continue
                pos, low, high = (at.field(k).to_numpy() for k in (1, 2, 3))
                n = len(pos)
                before = pa.array([data[p - h : p] for p, h in zip(pos, high)], pa.binary())
                after = pa.array([data[p : p + window - lo] for p, lo in zip(pos, low)], pa.binary())
                yield pa.RecordBatch.from_arrays([at.field(0), *(pa.repeat(batch.column(c)[i], n) for c in (0, 1)), at.field(1), at.field(2), at.field(3), before, after], names)

    schema = "key long, h1 long, h2 long, pos int, low int, high int, before binary, after binary"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    around = texts.mapInArrow(surroundings, schema).repartition(parts, "key").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            keys, low, high, pos, h1, h2 = (table.column(c).to_numpy() for c in ("key", "low", "high", "pos", "h1", "h2"))
            before, after = table.column("before").to_pylist(), table.column("after").to_pylist()
            for i, a, b in equal_windows(keys, before, after, low, high, window, anchor):
                yield pa.RecordBatch.from_arrays([pa.array(h1[i]), pa.array(h2[i]), pa.array((pos[i] - b).astype(np.int32)), pa.array((pos[i] - a + window).astype(np.int32))], ["h1", "h2", "start", "end"])

    spans = around.mapInArrow(compare, "h1 long, h2 long, start int, end int")
    if not several.where("hot").isEmpty():
        spans = spans.unionByName(hot_spans(texts, work, window, anchor))
    spans = work.put(spans.groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, held in zip(batch.column(2), batch.column(3)):
                data, held = data.as_py(), held.values
                order = np.argsort(start := held.field(0).to_numpy())
                kept, at, gone, n = [], 0, 0, 0
                for a, b in zip(start[order].tolist(), held.field(1).to_numpy()[order].tolist()):
                    if a > at or not n:
                        kept.append(data[at:a])
                        n += 1
                        at = a
                    gone += max(0, b - at)
                    at = max(at, b)
                kept.append(data[at:])
                out.append((b"".join(kept), len(data), gone, n))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["h1", "h2", "kept", "n_bytes", "n_removed", "n_spans"])

    done = texts.join(spans.hint("shuffle_hash"), ["h1", "h2"]).select("h1", "h2", "data", "spans").mapInArrow(cut, "h1 long, h2 long, kept binary, n_bytes long, n_removed long, n_spans long")
    return keyed, reps, done


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs.

    Null is as empty, texts under the window are kept whole, and of equal texts of at least a window nothing stays.
    Repeated rows are such equal texts; so are texts of one doc_id, and a row without a doc_id is treated as any other.
    Texts of any length are searched whole; an empty table gives an empty result. Columns besides doc_id and text are not read.
    """
    work = Workspace(docs.sparkSession, "suffix")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    keyed, reps, done = removed_spans(docs, work, window, anchor, hot)
    fates = reps.select("h1", "h2", "n_copies").join(done.select("h1", "h2", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")), ["h1", "h2"], "left")
    fates = work.put(fates.where("n_copies > 1 or sha is not null"), "fates")
    work.only(fates)
    data = F.col("text").cast("binary")
    rows = keyed.select("doc_id", "h1", "h2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(data, 256).alias("whole")).join(fates, ["h1", "h2"], "left")
    all_gone = (F.col("n_copies") > 1) & (F.col("n_bytes") >= window)
    return rows.select(
        "doc_id", "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with the bytes of repeated strings of `window` bytes taken out of `text`.

    All rows and columns stay, whatever their names. Of a character cut in half what is left is dropped. Null stays
    null, texts under the window stay whole, and of equal texts of at least a window nothing stays in either.
    """
    work = Workspace(docs.sparkSession, "suffix")
    _, reps, done = removed_spans(docs.select("doc_id", "text"), work, window, anchor)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x.as_py().decode("utf-8", "ignore") for x in batch.column(2)], pa.string())], ["h1", "h2", "kept"])

    done = done.select("h1", "h2", "kept").mapInArrow(decode, "h1 long, h2 long, kept string")
    fates = reps.select("h1", "h2", "n_copies").join(done, ["h1", "h2"], "left").where("n_copies > 1 or kept is not null")
    h1, h2, kept, copies = fresh_names(docs, "h1", "h2", "kept", "n_copies")
    fates = work.put(fates.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("kept").alias(kept), F.col("n_copies").alias(copies)), "fates")
    work.only(fates)
    rows = docs.withColumns(dict(zip((h1, h2), text_keys()))).join(fates, [h1, h2], "left")
    all_gone = (F.col(copies) > 1) & (F.octet_length("text") >= window)
    return rows.withColumn("text", F.when(all_gone, F.lit("")).otherwise(F.coalesce(kept, "text"))).select(*docs.columns)
