"""Near-duplicate passages by compact windows.

Tokens are shingles of five words. For each of three hash functions, the Cartesian tree over a text's hashes gives
compact windows (l, c, r): every subsequence that starts in [l, c] and ends in [c, r] has its least hash at c.
Only windows that hold a passage of the least length count, and their tops are among the minima of sliding windows
of that length, so the tree is built on those alone. Of windows whose key other texts have too, any two of different
functions that hold each other's top and a passage between them are joined to one key of both: what two texts share
must agree in two functions at one place. At a similarity of 0.8, two of three functions agree with a probability of
0.896, at 0.9 of 0.972. Places with a joint key in common are verified on the shingles themselves.

In a group of equal joint keys, members are first compared with its first and its last text. A place that this leaves
without a passage around its top is held against all places of its group: groups go by their first text, so that the
shingles of a text come once for keys that share most of their members, and large ones are parted into pairs of blocks.
There the number of distinct shingles that two texts share, and then what a passage around an open top must share with
the other text's stretch, bound what can be verified; likest texts come first, and a place is done once a passage covers
its top. Where passages end beside it, stretches around the top itself are tried.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from foliant.llm.kernels import NOT_SPACE, U, Block, blocks, mix, shingles, span_hash
from foliant.workspace import Workspace

WORDS, HASHES = 5, 3
#: The last bits of a key tell its function.
WHICH = U(3)
SALTS = [int(x) for x in np.random.default_rng(29).integers(1, 1 << 63, HASHES)]
#: A window is packed as the place of its top and how far it reaches to both sides; what reaches further is cut there,
#: so that a passage of over half a million words is found in parts.
REACH = (1 << 19) - 1
#: Members of a group that are held against each other in one task.
GROUP = 250
#: So many of the likest members are bounded and compared first; often they leave no top open.
FIRST = 8
#: Values in an array of such bounds; what is read at once has a few times as many.
AREA = 1 << 16


def sliding_minima(values: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Sorted positions that are the leftmost minimum of some window of `width` values within a row."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    keyed = (values & ~U(0xFFFFFFFF)) | np.arange(len(values), dtype=U)
    padded = np.concatenate([keyed, np.full(-len(keyed) % width, ~U(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & U(0xFFFFFFFF)
    row_end = np.repeat(first[1:], np.diff(first))[:n]
    return np.unique(least[np.arange(n) + width <= row_end]).astype(np.int64)


def compact_windows(values: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """(l, c, r) of at least `width` values for each row, by a stack that holds the tree's right spine."""
    tops = sliding_minima(values, first, width)
    if not len(tops):
        return np.zeros((0, 3), np.int64)
    row = np.searchsorted(first, tops, "right") - 1
    # Each row begins with a mark that is less than all values, so that the spine starts anew there.
    at = np.arange(len(tops)) + np.cumsum(np.diff(row, prepend=-1) != 0)
    marked = np.full(int(at[-1]) + 1, -1, np.int64)
    marked[at] = (values[tops] >> U(32)).astype(np.int64)
    before, behind = [0] * len(marked), [len(marked)] * len(marked)
    spine: list[int] = [0]
    least = marked.tolist()
    for i, v in enumerate(least):
        while least[spine[-1]] > v:
            behind[spine.pop()] = i
        before[i] = spine[-1]
        spine.append(i)
    place = np.full(len(marked) + 1, -1)
    place[at] = tops
    left, right = place[np.array(before)[at]], place[np.array(behind)[at]]
    left, right = np.where(left < 0, first[row], left + 1), np.where(right < 0, first[row + 1], right) - 1
    fit = right - left + 1 >= width
    return np.stack([left, tops, right], axis=1)[fit]


def text_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = block.spans(NOT_SPACE)
    return span_hash(block.prefix(), starts, ends), first


def text_shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*text_words(block), WORDS)


def window_rows(docs: DataFrame, least: int) -> DataFrame:
    """key, h, packed (top, reach left, reach right) of each compact window; and for each row its doc_id, h and, as packed,
    number of words."""
    width = least - WORDS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch):
                words, first_word = text_words(block)
                tokens, first = shingles(words, first_word, WORDS)
                keys, rows, packed = [], [np.arange(block.rows)], [np.diff(first_word)]
                for which, salt in enumerate(SALTS):
                    values = (mix(tokens ^ U(salt)) & ~WHICH) | U(which)
                    left, top, right = compact_windows(values, first, width).T
                    row = np.searchsorted(first, top, "right") - 1
                    keys.append(values[top])
                    rows.append(row)
                    packed.append(((top - first[row]) << 38) | (np.minimum(top - left, REACH) << 19) | np.minimum(right - top, REACH))
                key = pa.array(np.concatenate(keys).view(np.int64))
                h = part.column(1).take(pa.array(np.concatenate(rows)))
                columns = [pa.concat_arrays([pa.nulls(block.rows, pa.int64()), key]), h, pa.array(np.concatenate(packed)), pa.concat_arrays([part.column(0), pa.nulls(len(key), pa.int64())])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "h", "packed", "doc_id"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, "key long, h long, packed long, doc_id long")


def nested(left: np.ndarray, right: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, ...]:
    """For windows that are nested or apart, by left end and outer ones first: the one around each, the next of another
    name, and at sorted places which is the innermost from there on; -1 if there is none."""
    around, other, at, inner, stack = [], [], [], [], []
    rights, name = right.tolist(), names.tolist()
    for i, low in enumerate([*left.tolist(), 1 << 62]):
        while stack and rights[stack[-1]] < low:
            at.append(rights[stack.pop()] + 1)
            inner.append(stack[-1] if stack else -1)
        if i == len(rights):
            break
        up = stack[-1] if stack else -1
        around.append(up)
        other.append(other[up] if up >= 0 and name[up] == name[i] else up)
        at.append(low)
        inner.append(i)
        stack.append(i)
    return tuple(np.array(x, np.int64) for x in (around, other, at, inner))


def joint_windows(keys: np.ndarray, packed: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Joint keys and packed places of one text's windows."""
    return joint_windows_of(np.zeros(len(keys), np.int64), keys, packed, width)[:2]


def joint_windows_of(text: np.ndarray, keys: np.ndarray, packed: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joint keys and packed places of the windows of numbered texts: those of two functions that hold each other's top;
    and the first window of each.

    Windows of one function are nested or apart. So each top has the innermost window of another function around it,
    from which all go outwards step by step; where one is taken, past others of its key.
    """
    which = (keys.view(np.uint64) & WHICH).astype(np.int64)
    c = (packed >> 38) + (text << 32)
    left, right = c - ((packed >> 19) & REACH), c + (packed & REACH)
    ones, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for f in range(HASHES - 1):
        own, j = np.flatnonzero(which == f), np.flatnonzero(which > f)
        if not len(own) or not len(j):
            continue
        own = own[np.lexsort((-right[own], left[own]))]
        low, high, top = left[own], right[own], c[own]
        around, other, at, inner = nested(low, high, keys[own])
        i = np.append(-1, inner)[np.searchsorted(at, c[j], "right")]
        while len(i := i[live := i >= 0]):
            j = j[live]
            a, z = left[j], right[j]
            taken = (a <= top[i]) & (top[i] <= z) & (np.minimum(high[i], z) - np.maximum(low[i], a) + 1 >= width)
            ones.append(own[i[taken]])
            others.append(j[taken])
            i = np.where(taken, other[i], around[i])
    i, j = np.concatenate(ones), np.concatenate(others)
    joint = mix(keys.view(np.uint64)[i] * U(0xD6E8FEB86659FD93) + keys.view(np.uint64)[j]).view(np.int64)
    low, high = np.maximum(left[i], left[j]), np.minimum(right[i], right[j])
    return joint, (packed[i] >> 38 << 38) | ((c[i] - low) << 19) | (high - c[i]), i


def places(hits: list[tuple[int, int, int]], width: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, to) in one text and in the other where windows overlap; hits are (packed, packed, key)."""
    opened = []
    for a, b, key in hits:
        ca, cb = a >> 38, b >> 38
        la, ra, lb, rb = (a >> 19) & REACH, a & REACH, (b >> 19) & REACH, b & REACH
        # What both windows hold, on the diagonal of their tops.
        opened.append((ca - cb, ca - min(la, lb), ca + min(ra, rb), key))
    opened.sort()
    i = 0
    while i < len(opened):
        j = i + 1
        while j < len(opened) and opened[j][0] - opened[j - 1][0] <= 2 * WORDS:
            j += 1
        spans = sorted(opened[i:j], key=lambda x: x[1])
        start, end, keys, shifts = spans[0][1], spans[0][2], {spans[0][3]}, [spans[0][0]]
        for shift, s, e, key in [*spans[1:], (0, 1 << 40, 1 << 40, 0)]:
            if min(end, e) - s + 1 >= width // 2:
                end = max(end, e)
                keys.add(key)
                shifts.append(shift)
                continue
            if end - start + 1 >= width:
                yield start, end, start - max(shifts), end - min(shifts)
            start, end, keys, shifts = s, e, {key}, [shift]
        i = j


def changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; the first one does."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def leftmost_least(x: np.ndarray) -> np.ndarray:
    """For each value, where the least one up to it stands first."""
    least = np.minimum.accumulate(x)
    return np.maximum.accumulate(np.where(np.append(True, least[1:] < least[:-1]), np.arange(len(x)), 0))


class Aligned:
    """Where shingles of a stand in b, and how similar stretches on their diagonal are."""

    def __init__(self, a: np.ndarray, b: np.ndarray, width: int, least: float):
        self.a, self.b, self.width, self.least = a, b, width, least
        order = b.argsort(kind="stable")
        sorted_b = b[order]
        at = sorted_b[:-1].searchsorted(a)
        self.where, self.same = order[at], sorted_b[at] == a
        sorted_a = np.sort(a)
        # Where no shingle comes twice, what sets share is counted by places.
        self.plain = bool((sorted_a[1:] != sorted_a[:-1]).all() and (sorted_b[1:] != sorted_b[:-1]).all())

    def tried(self, start: int, to: int) -> tuple[int, int, float] | None:
        """From, to and similarity of the stretch of b that a passage of a is verified against; none if it fails."""
        a, b = self.a, self.b
        matched = self.same[start : to + 1].nonzero()[0]
        if not len(matched) or self.plain and len(matched) < self.least * (to - start + 1):
            return None
        places_b = self.where[start + matched]
        shifts = places_b - matched
        shifts.sort()
        # By the middle of the shifts; where one word fills the stretch, shifts mean nothing, so by its first place.
        for shift in (int((shifts[(len(shifts) - 1) // 2] + shifts[len(shifts) // 2]) / 2), int(places_b.min())):
            from_b, to_b = max(0, shift), min(len(b) - 1, shift + to - start)
            if to_b - from_b + 1 < self.width:
                continue
            if self.plain:
                shared = int(np.count_nonzero((places_b >= from_b) & (places_b <= to_b)))
                union = to - start + 1 + to_b - from_b + 1 - shared
            else:
                x, y = set(a[start : to + 1].tolist()), set(b[from_b : to_b + 1].tolist())
                shared = len(x & y)
                union = len(x) + len(y) - shared
            if shared >= self.least * union:
                return from_b, to_b, shared / union
        return None

    def around(self, tops: list[int]) -> dict[int, tuple[int, int, int, int, float]]:
        """By place, the like of what verified() gives for a stretch that holds it: of those of greatest gain by three
        prices of mismatches, the first that is similar enough."""
        n, width, out = len(self.same), self.width, {}
        tried = functools.cache(self.tried)
        for price in (self.least, 2 * self.least / (1 + self.least), 0.96) if n >= width else ():
            sums = np.concatenate([[0], np.cumsum(self.same - price)])
            before, back = leftmost_least(sums[:-1]), n - leftmost_least(-sums[:0:-1])[::-1]
            ends = sums[width:] - sums[:-width]
            for top in tops:
                if top in out:
                    continue
                start, to = int(before[top]), int(back[top]) - 1
                if to - start + 1 < width:
                    first = max(0, top + 1 - width)
                    start = first + int(ends[first : top + 1].argmax())
                    to = start + width - 1
                if found := tried(start, to):
                    out[top] = start, to, *found
        return out


def verified(a: np.ndarray, b: np.ndarray, width: int, least: float, by: Aligned | None = None, wanted: Sequence[int] | None = None) -> Iterator[tuple[int, int, int, int, float]]:
    """Stretches of a that b holds too: (from, to) in a, (from, to) in b, similarity.

    The stretch of greatest gain is tried with ever dearer mismatches until it is similar enough; one that is too short
    for that may still be with what stands beside it, so the stretch of least length with most matches is tried last.
    Then comes what lies to its left and right; of that only what holds a wanted place, if such are given, in order.
    """
    if len(a) < width or not len(b):
        return
    by = by or Aligned(a, b, width, least)
    matched = np.concatenate([[0], np.cumsum(by.same)])
    # Of two stretches of distinct shingles, each of `width` at least.
    need = 2 * width * least / (1 + least) - 1e-6 if by.plain else 1
    rest = [(0, len(a))]
    while rest:
        low, high = rest.pop()
        if high - low < width or matched[high] - matched[low] < need:
            continue
        if wanted is not None and bisect_left(wanted, low) == bisect_left(wanted, high):
            continue
        for start, to in stretches(by, matched, low, high):
            if to - start + 1 >= width and (found := by.tried(start, to)):
                yield start, to, *found
                rest += [(low, start), (to + 1, high)]
                break


def stretches(by: Aligned, matched: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """(from, to) between low and high that are to be tried, each once."""
    tried, width, same = set(), by.width, by.same[low:high]
    sums = np.zeros(high - low + 1)
    for price in (by.least, 0.9, 0.96, 0.995):
        (same - price).cumsum(out=sums[1:])
        before = sums[:-1]
        floor = np.minimum.accumulate(before)
        to = int((sums[1:] - floor).argmax())
        start = to - int((before[to::-1] <= floor[to] + 1e-12).argmax())
        if (start, to) not in tried:
            tried.add((start, to))
            yield start + low, to + low
    best = int((matched[low + width : high + 1] - matched[low : high + 1 - width]).argmax())
    if (best, best + width - 1) not in tried:
        yield best + low, best + low + width - 1


def fewest_distinct(tokens: np.ndarray, width: int) -> int:
    """The least number of distinct tokens in any `width` in a row; 0 if there are fewer tokens."""
    n = len(tokens)
    if n < width:
        return 0
    values = np.sort(tokens)
    if (values[1:] != values[:-1]).all():
        return width
    order = np.argsort(tokens, kind="stable")
    before = np.full(n, -1)
    again = tokens[order[1:]] == tokens[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    # A token counts in the windows that start behind its last occurrence before and reach it.
    at = np.arange(n)
    start = np.maximum(before, at - width) + 1
    gain = np.bincount(start, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
    return int(np.cumsum(gain)[: n - width + 1].min())


def matches(flat: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value stands in sorted values, one after the other, and how often each does."""
    a, z = np.searchsorted(flat, wanted, "left"), np.searchsorted(flat, wanted, "right")
    run = z - a
    return np.repeat(a - np.cumsum(run) + run, run) + np.arange(run.sum()), run


class Side:
    """Members of a group with their shingles, from a place in the text on, and their places."""

    def __init__(self, hs: list[int], froms: list[int], tokens: list[np.ndarray], owner: np.ndarray, keys: np.ndarray, packed: np.ndarray, open_: np.ndarray, width: int, least: float):
        order = np.lexsort((keys, owner))
        self.hs, self.froms, self.tokens = hs, froms, tokens
        self.keys, self.packed, self.open = keys[order], packed[order], open_[order].copy()
        self.first, self.top = np.searchsorted(owner[order], np.arange(len(tokens) + 1)), self.packed >> 38
        # Two sides of at least so many distinct shingles each share the sum of both at least, to have the similarity asked for.
        self.need = np.array([least / (1 + least) * n if (n := fewest_distinct(t, width)) else np.inf for t in tokens]) - 1e-9
        self.by_h = {h: i for i, h in enumerate(hs)}

    def close(self, h: int, start: int, to: int) -> bool:
        """Whether a passage covers open places of a member, which then are open no more."""
        i = self.by_h.get(h)
        if i is None:
            return False
        at = slice(self.first[i], self.first[i + 1])
        closed = self.open[at] & (self.top[at] >= start) & (self.top[at] <= to)
        self.open[at] &= ~closed
        return bool(closed.any())

    def open_among(self, i: int, start: int, places: np.ndarray) -> list[int]:
        """Tops of a member's open places that are among those marked, from a place of the text on, counted from there."""
        at = slice(self.first[i], self.first[i + 1])
        top = self.top[at][self.open[at]] - start
        top = top[(top >= 0) & (top < len(places))]
        return np.unique(top[places[top]]).tolist()


def found_for(by: Aligned, side: Side, i: int, start: int, can: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """Passages of a member's stretch where its open tops are, and then those around open tops that these don't cover.
    Where shingles come twice, nearly all tops of a run would have to be tried one by one, so the former must do."""
    yield from verified(by.a, by.b, by.width, by.least, by, side.open_among(i, start, can))
    if by.plain and (tops := side.open_among(i, start, can)):
        yield from dict.fromkeys(by.around(tops).values())


def greatest_of(x: np.ndarray, k: int) -> np.ndarray:
    """The greatest of each k values in a row."""
    n = 1
    while n < k:
        step = min(n, k - n)
        x, n = np.maximum(x[:, : x.shape[1] - step], x[:, step:]), n + step
    return x


def coverable(gain: np.ndarray, early: np.ndarray, late: np.ndarray, width: int) -> np.ndarray:
    """Which places of each row some stretch of at least `width` covers that has a sum of gains of 0 or more, with what
    is allowed to it for starting early and for ending late."""
    rows, n = gain.shape
    sums = np.zeros((rows, n + 1), gain.dtype)
    np.cumsum(gain, axis=1, out=sums[:, 1:])
    low = np.minimum.accumulate(sums[:, :-1] - early, axis=1)
    ends = sums[:, 1:] + late
    # What ends less than `width` behind a place starts at or before it, being that long.
    best = np.full((rows, n + width - 1), -np.inf, gain.dtype)
    best[:, width - 1 : n] = ends[:, width - 1 :] - low[:, : n - width + 1]
    best = greatest_of(best, width)
    high = np.maximum.accumulate(ends[:, : width - 2 : -1], axis=1)[:, ::-1]
    np.maximum(best[:, : n - width + 1], high - low[:, : n - width + 1], out=best[:, : n - width + 1])
    return best >= -0.01


class Index:
    """Shingles of a side's members, and the first place of each in a member; and the places of all members by their keys."""

    def __init__(self, side: Side):
        sizes = np.array([len(t) for t in side.tokens], np.int64)
        flat = np.concatenate([*side.tokens, np.zeros(0, np.uint32)])
        member = np.repeat(np.arange(len(sizes)), sizes)
        start = np.cumsum(sizes) - sizes
        order = np.lexsort((np.arange(len(flat)), member, flat))
        first = np.ones(len(flat), bool)
        first[1:] = (flat[order[1:]] != flat[order[:-1]]) | (member[order[1:]] != member[order[:-1]])
        #: Whether no shingle comes twice in a member.
        self.plain = np.ones(len(sizes), bool)
        self.plain[member[order[~first]]] = False
        at = order[first]
        self.flat, self.member, self.at = flat[at], member[at], at - start[member[at]]
        self.place = np.argsort(side.keys, kind="stable")
        self.keys, self.owner = side.keys[self.place], np.repeat(np.arange(len(sizes)), np.diff(side.first))[self.place]


def places_by_member(member: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """The same as places() for hits with many members at once: (member, from, to, from, to) as columns."""
    ca, cb = a >> 38, b >> 38
    shift = ca - cb
    low, high = ca - np.minimum((a >> 19) & REACH, (b >> 19) & REACH), ca + np.minimum(a & REACH, b & REACH)
    order = np.argsort((member << 32) + shift)
    apart = changes(member[order])
    apart[1:] |= (shift := shift[order])[1:] - shift[:-1] > 2 * WORDS
    kind, member, low, high = np.cumsum(apart), member[order], low[order], high[order]
    order = np.lexsort(((shift << 32) + high, (kind << 32) + low))
    member, shift, low, high, kind = (x[order] for x in (member, shift, low, high, kind))
    short = high - low + 1 < width // 2
    fresh = changes(kind)
    breaks = fresh | short
    breaks[1:] |= short[:-1]
    part = np.cumsum(breaks)
    # Within such a part, how far what came before reaches.
    far = np.maximum.accumulate(high + (part << 40)) - (part << 40)
    starts = breaks
    starts[1:] |= far[:-1] - low[1:] + 1 < width // 2
    at = np.flatnonzero(starts)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    start, to = low[at], np.maximum.reduceat(high, at)
    out = member[at], start, to, start - np.maximum.reduceat(shift, at), to - np.minimum.reduceat(shift, at)
    return tuple(x[to - start + 1 >= width] for x in out)


def hopeful(open_: np.ndarray, alone: np.ndarray, where: np.ndarray, held: tuple[np.ndarray, ...], strict: np.ndarray, width: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, places) where a passage of a text may cover an open top, and which shingles of the stretch.

    open_ and alone mark the text's open tops and shingles that come once, where has a row for each member: the place there
    of each shingle of the text. held has the row, from and to in the text, from and to in the member.
    A passage of n distinct shingles that is similar to one of m shares least / (1 + least) of n + m with it. It is held
    against a stretch of the other text, on a diagonal of shingles that both have, which is as long unless it is cut where
    its place ends; so n is over m by what is cut at most. Where shingles come twice, which is not strict, `least` of the
    distinct ones is asked for.
    """
    half = least / (1 + least)
    opened = np.concatenate([[0], np.cumsum(open_)])
    row, a, z, b, y = held
    n = z - a + 1
    order = np.flatnonzero(opened[z + 1] > opened[a])
    order = order[np.argsort(n[order], kind="stable")]
    while len(order):
        # Places of about one length, in arrays of bounded size.
        longest = int(n[order[-1]])
        most = min(max(1, AREA // longest), len(order) - int(np.searchsorted(n[order], longest // 2)))
        now, order = order[-most:], order[:-most]
        at = np.arange(longest)
        i = np.minimum(a[now, None] + at, len(alone) - 1)
        there = where.ravel().take(row[now, None] * len(alone) + i)
        inside = at < n[now, None]
        found = (there >= b[now, None]) & (there <= y[now, None]) & inside
        price = np.where(strict[now], 2 * half, least)
        some = np.flatnonzero((found.sum(axis=1) >= price * width - 0.01) | ~strict[now])
        if not len(some):
            continue
        now, i, there, inside, found, price = now[some], i[some], there[some], inside[some], found[some], price[some, None]
        gain = np.where(found, 1 - price, -price)
        if not strict[now].all():
            gain[~found & ~alone[i]] = 0
        gain[~inside] = -longest
        drift = there - at
        early, late = b[now] - np.where(found, drift, 1 << 40).min(axis=1), np.where(found, drift, -1 << 40).max(axis=1) - y[now]
        early, late = (np.where(strict[now], x, -longest)[:, None] for x in (early, late))
        can = coverable(gain, half * np.maximum(0, early - at), half * np.maximum(0, late + at), width)
        for r in np.flatnonzero((can & open_[i] & inside).any(axis=1)).tolist():
            yield int(now[r]), can[r, : n[now[r]]]


def portions(left: Side, i: int, right: Side, index: Index, fits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Members to the right in lists of bounded size, and the pairs of a left member's places and theirs that have a key in
    common: number in the list, place to the left, to the right. Closed places count too: they tell how far what two texts
    share may reach."""
    mine = np.arange(left.first[i], left.first[i + 1])
    keys, size = left.keys[mine], len(left.tokens[i])
    low, high = np.searchsorted(index.keys, keys, "left"), np.searchsorted(index.keys, keys, "right")
    if (high - low).sum() > 64 * AREA:
        # Too many to hold at once, as of runs of one word.
        held, some, most = [], 0, FIRST
        for j in fits.tolist():
            y, run = matches(right.keys[right.first[j] : right.first[j + 1]], keys)
            if len(y):
                held.append((j, np.repeat(mine, run), right.first[j] + y))
                some += len(y) + size
            if len(held) >= most or some > 4 * AREA:
                yield listed(held)
                held, some, most = [], 0, len(fits)
        if held:
            yield listed(held)
        return
    y, run = matches(index.keys, keys)
    rank = np.full(len(right.hs), len(fits))
    rank[fits] = np.arange(len(fits))
    by = rank[index.owner[y]]
    order = np.argsort(by, kind="stable")[: np.count_nonzero(by < len(fits))]
    by, x, y = by[order], np.repeat(mine, run)[order], index.place[y[order]]
    starts = np.append(np.flatnonzero(changes(by)), len(by))
    at, sizes = 0, np.cumsum(starts[1:] - starts[:-1] + size)
    while at < len(sizes):
        # Up to the member with which the size is passed, and at first no more than FIRST.
        to = min(len(sizes), int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 4 * AREA, "right")) + 1, len(sizes) if at else FIRST)
        part = slice(starts[at], starts[to])
        yield fits[by[starts[at:to]]], np.repeat(np.arange(to - at), starts[at + 1 : to + 1] - starts[at:to]), x[part], y[part]
        at = to


def listed(held: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    members, x, y = zip(*held)
    return np.array(members), np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x), np.concatenate(y)


def links_of_cell(left: Side, right: Side, width: int, least: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(h, start_word, n_words, other, similarity) for open places of left members, each held against all of its key to the right.

    A place is open until a passage covers its top; passages that cover none are left out. For each left member, all
    right ones with a key of it are bounded at once: by the shingles in common, then by whether any stretch
    around an open top can be similar enough. Only what passes is compared, likest first.
    """
    index = Index(right)
    froms = np.array(right.froms, np.int64)
    ends = froms + [len(t) for t in right.tokens] - 1
    for i, h in enumerate(left.hs):
        mine = slice(left.first[i], left.first[i + 1])
        if not left.open[mine].any() or not np.isfinite(left.need[i]):
            continue
        tokens, from_ = left.tokens[i], left.froms[i]
        own, back, times = np.unique(tokens, return_inverse=True, return_counts=True)
        at, run = matches(index.flat, own)
        others, which, there = index.member[at], np.repeat(np.arange(len(own)), run), index.at[at]
        shared = np.bincount(others, minlength=len(right.hs))
        if h in right.by_h:
            shared[right.by_h[h]] = 0
        fits = np.flatnonzero(shared >= right.need + left.need[i])
        fits = fits[np.argsort(-shared[fits], kind="stable")]
        row_of = np.full(len(right.hs), -1)
        for members, row, x, y in portions(left, i, right, index, fits) if len(fits) else ():
            if not left.open[mine].any():
                break
            row, a, z, b, y = places_by_member(row, left.packed[x], right.packed[y], width)
            a, z, b, y = np.maximum(a, from_), np.minimum(z, from_ + len(tokens) - 1), np.maximum(b, froms[members[row]]), np.minimum(y, ends[members[row]])
            fit = (z - a + 1 >= width) & (y - b + 1 >= width)
            if not fit.any():
                continue
            row, a, z, b, y = held = tuple(v[fit] for v in (row, a - from_, z - from_, b - froms[members[row]], y - froms[members[row]]))
            row_of[:] = -1
            row_of[members] = np.arange(len(members))
            to_row = row_of[others]
            kept = to_row >= 0
            where = np.full((len(members), len(own)), -1, np.int32)
            where[to_row[kept], which[kept]] = there[kept]
            open_ = np.zeros(len(tokens), bool)
            open_[np.clip(left.top[mine][left.open[mine]] - from_, 0, len(tokens) - 1)] = True
            strict = index.plain[members[row]] & (len(own) == len(tokens))
            for k, can in sorted(hopeful(open_, times[back] == 1, where[:, back], held, strict, width, least), key=lambda r: r[0]):
                j, from_a, from_b = int(members[row[k]]), int(a[k]), int(b[k])
                if not left.open_among(i, from_ + from_a, can):
                    continue
                by = Aligned(tokens[from_a : z[k] + 1], right.tokens[j][from_b : y[k] + 1], width, least)
                for start, to, low, high, sim in found_for(by, left, i, from_ + from_a, can):
                    ours = h, from_ + from_a + start, from_ + from_a + to, right.hs[j]
                    theirs = right.hs[j], right.froms[j] + from_b + low, right.froms[j] + from_b + high, h
                    for t, s, e, other in (ours, theirs):
                        if left.close(t, s, e):
                            yield t, s, e - s + WORDS, other, sim


def links_of_group(hs: list[int], froms: list[int], tokens: list[np.ndarray], owner: np.ndarray, keys: np.ndarray, packed: np.ndarray, open_: np.ndarray, width: int, least: float) -> Iterator[tuple[int, int, int, int, float]]:
    """The same for a group whose members are held against each other. owner, keys, packed and open_ have a row for each
    place; tokens[i] are text i's shingles from froms[i] on."""
    both = Side(hs, froms, tokens, owner, keys, packed, open_, width, least)
    yield from links_of_cell(both, both, width, least)


def repeated_passages(docs: DataFrame, *, least_words: int = 50, least: float = 0.8) -> DataFrame:
    """doc_id, start_word, n_words, partner_doc_id, similarity: the passages of a document that another holds too.

    Passages have at least `least_words` words and share at least `least` of their five-word shingles (Jaccard).
    A passage has one row, with the least doc_id among the texts that it was verified against; documents without one
    have no row. Of equal texts of that length each has a row for the whole text. Null and shorter texts have none, and
    rows without a doc_id are left out. Repeated rows are one document; of partners the least doc_id is named. Texts of
    any length are read whole; an empty table gives an empty result.
    Texts are told apart by a 64-bit hash. Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "substring")
    width = least_words - WORDS + 1
    keyed = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    windows = work.put(window_rows(keyed, least_words), "windows")
    rows = work.put(windows.where("doc_id is not null").select("doc_id", "h", F.col("packed").alias("n_words")), "rows")
    reps = work.put(rows.groupBy("h").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.max("n_words").alias("n_words")), "texts")
    # Half of a text's hash tells whether a key has two texts; it halves what this step moves.
    half = F.shiftright("h", 32).cast("int")
    ends = windows.where("key is not null").groupBy("key").agg(F.min(half).alias("low"), F.max(half).alias("high")).where("low != high")
    ends = work.put(ends, "shared")
    work.sweep()
    hit = work.put(windows.join(ends, "key").select("key", "h", "packed").distinct(), "hits")
    work.drop(windows, ends)
    work.sweep()
    held = hit.groupBy("h").agg(F.collect_list(F.struct("key", "packed")).alias("w"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            flat, text = held.flatten(), np.repeat(np.arange(len(held)), held.value_lengths().to_numpy())
            keys, packed, first = joint_windows_of(text, *(flat.field(i).to_numpy() for i in range(2)), width)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(pa.array(text[first])), pa.array(packed)], ["key", "h", "packed"])

    joint = work.put(held.mapInArrow(joined, "key long, h long, packed long"), "joint")
    work.drop(hit)
    # With each place one of the first and one of the last text of its key.
    of_key = Window.partitionBy("key")
    ends = F.min(F.struct("h", "packed")), F.max(F.struct("h", (-F.col("packed")).alias("packed"))), F.count("*")
    met = joint.select("*", *(e.over(of_key).alias(n) for e, n in zip(ends, ("first", "last", "n")))).where("first.h != last.h")
    met = met.selectExpr("key", "h", "packed", "n", "first.h as low", "first.packed as low_at", "last.h as high", "-last.packed as high_at")
    met = work.put(met, "met")
    hits = [met.where(F.col("h") != F.col(end)).select("h", F.col(end).alias("other"), "packed", F.col(f"{end}_at").alias("there")) for end in ("low", "high")]
    pairs = hits[0].union(hits[1]).groupBy("h", "other").agg(F.collect_list(F.struct("packed", "there")).alias("hits"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(2)
            flat, pair = held.flatten(), np.repeat(np.arange(len(held)), held.value_lengths().to_numpy())
            pair, *place = places_by_member(pair, *(flat.field(i).to_numpy() for i in range(2)), width)
            columns = [batch.column(i).take(pa.array(pair)) for i in range(2)] + [pa.array(np.maximum(x, 0)) for x in place]
            yield pa.RecordBatch.from_arrays(columns, ["h", "other", "a", "b", "c", "d"])

    found = work.put(pairs.mapInArrow(find, "h long, other long, a long, b long, c long, d long"), "places")
    work.drop(joint)
    work.sweep()
    wanted = found.select("h", F.col("a").alias("from"), F.col("b").alias("to")).union(found.select("other", "c", "d")).distinct()
    held = wanted.groupBy("h", F.pmod(F.xxhash64("from", "to"), F.lit(32)).alias("part")).agg(F.collect_list(F.struct("from", "to")).alias("at"))
    held = work.put(held.join(reps.select("h", "rep"), "h"), "wanted")
    texts = keyed.join(held.hint("shuffle_hash"), "h").where("doc_id = rep").select("h", "text", "at")  # a repeated row only repeats its slices

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch):
                tokens, first = text_shingles(block)
                out = []
                for i, (h, at) in enumerate(zip(part.column(0).to_pylist(), part.column(2))):
                    own = (tokens[first[i] : first[i + 1]] >> U(32)).astype(np.uint32)
                    v = at.values
                    out += [(h, x, y, own[x : y + 1].tobytes()) for x, y in zip(v.field(0).to_pylist(), v.field(1).to_pylist())]
                columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "from", "to", "tokens"])

    slices = work.put(texts.mapInArrow(cut, "h long, from long, to long, tokens binary"), "slices")
    work.drop(held)
    work.sweep()
    one = slices.select("h", F.col("from").alias("a"), F.col("to").alias("b"), F.col("tokens").alias("x"))
    two = slices.select(F.col("h").alias("other"), F.col("from").alias("c"), F.col("to").alias("d"), F.col("tokens").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, other, a, c, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), batch.column(5)):
                for start, to, from_b, to_b, sim in verified(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), width, least):
                    out.append((h, a + start, to - start + WORDS, other, sim))
                    out.append((other, c + from_b, to_b - from_b + WORDS, h, sim))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "start_word", "n_words", "other", "similarity"])

    both = found.join(one, ["h", "a", "b"]).join(two, ["other", "c", "d"]).select("h", "other", "a", "c", "x", "y")
    schema = "h long, start_word long, n_words long, other long, similarity double"
    passages = work.put(both.mapInArrow(compare, schema), "found-passages")
    work.drop(found, slices)
    work.sweep()
    # Where a key has more than two places, those that no passage covers by now are open.
    covered = passages.groupBy("h").agg(F.collect_set(F.struct(F.col("start_word").alias("a"), (F.col("start_word") + F.col("n_words") - WORDS).alias("b"))).alias("done"))
    top = F.shiftright("packed", 38)
    is_open = ~F.coalesce(F.exists("done", lambda x: (x["a"] <= top) & (x["b"] >= top)), F.lit(False))
    many = met.where("n > 2").select("key", "h", "packed", "low").join(covered, "h", "left").select("key", "h", "packed", "low", is_open.alias("open"))
    many = work.put(many, "many")
    work.drop(met)
    rest = many.join(work.put(many.where("open").select("key").distinct(), "open-keys"), "key", "left_semi")
    place = F.struct("key", "packed", "open")
    reach = F.min(top - F.shiftright("packed", 19).bitwiseAND(REACH)).alias("from"), F.max(top + F.col("packed").bitwiseAND(REACH)).alias("to")
    rest = rest.groupBy("h", "low").agg(*reach, F.collect_list(place).alias("places"))
    # A passage may reach beyond the windows a little, where words were put in.
    rest = rest.select("h", F.struct("low", F.greatest(F.lit(0), F.col("from") - width).alias("from"), (F.col("to") + width).alias("to"), "places").alias("at"))
    rest = work.put(rest.groupBy("h").agg(F.collect_list("at").alias("at")).join(reps.select("h", "rep"), "h"), "rest")
    work.drop(many)
    work.sweep()
    texts = keyed.join(rest.hint("shuffle_hash"), "h").where("doc_id = rep").select("h", "text", "at")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch):
                tokens, first = text_shingles(block)
                at = part.column(2)
                flat = at.flatten()
                row = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
                low, start, to, held = (flat.field(i) for i in range(4))
                cells = [(tokens[first[i] : first[i + 1]][x : y + 1] >> U(32)).astype(np.uint32).tobytes() for i, x, y in zip(row, start.to_pylist(), to.to_pylist())]
                yield pa.RecordBatch.from_arrays([low, part.column(0).take(pa.array(row)), start, pa.array(cells, pa.binary()), held], ["low", "h", "from", "tokens", "places"])

    kind = "array<struct<key: long, packed: long, open: boolean>>"
    members = texts.mapInArrow(spread, f"low long, h long, from long, tokens binary, places {kind}")
    # A group of over GROUP members is parted into blocks, and each pair of blocks is a cell of its own.
    sizes = rest.select(F.explode("at.low").alias("low")).groupBy("low").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks")).where("blocks > 1")
    members = members.join(work.put(sizes, "large-groups"), "low", "left")
    has_open, block = F.exists("places", lambda p: p["open"]), F.pmod(F.hash("h"), F.col("blocks"))
    cell = lambda c, left, right: F.struct(c.cast("int").alias("cell"), left.alias("left"), right.alias("right"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = F.when(has_open, F.transform(every, lambda q: cell(block * F.col("blocks") + q, F.lit(True), F.lit(False)))).otherwise(F.array())
    right = F.transform(every, lambda p: cell(p * F.col("blocks") + block, F.lit(False), F.lit(True)))
    cells = F.when(F.col("blocks").isNull(), F.array(cell(F.lit(0), has_open, F.lit(True)))).otherwise(F.concat(left, right))
    members = members.select("low", "h", "from", "tokens", "places", F.explode(cells).alias("c")).select("low", "h", "from", "tokens", "places", "c.*")

    def side(table: pa.Table) -> Side:
        table = table.take(pa.array(np.unique(table["h"].to_numpy(), return_index=True)[1]))  # rows may be repeated
        held = table["places"].combine_chunks()
        flat = held.flatten()
        owner = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy())
        key, packed, open_ = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        tokens = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["tokens"]]
        return Side(table["h"].to_pylist(), table["from"].to_pylist(), tokens, owner, key, packed, open_.astype(bool), width, least)

    def settle(table: pa.Table) -> pa.Table:
        ours, theirs = table.filter(table["left"]), table.filter(table["right"])
        out: list = []
        if ours.num_rows and theirs.num_rows:
            right = side(theirs)
            left = right if theirs.num_rows == table.num_rows else side(ours)
            out = list(links_of_cell(left, right, width, least))
        columns = zip(*out) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["h", "start_word", "n_words", "other", "similarity"])

    # Cells hold few bytes and much work, so their number of partitions doesn't follow their size.
    dealt = members.repartition(8 * spark.sparkContext.defaultParallelism, "low", "cell")
    settled = work.put(dealt.groupBy("low", "cell").applyInArrow(settle, schema), "settled")
    passages = passages.union(settled)
    partner = reps.select(F.col("h").alias("other"), F.col("rep").alias("partner_doc_id"))
    passages = passages.join(partner, "other").groupBy("h", "start_word", "n_words").agg(F.min(F.struct("partner_doc_id", "similarity")).alias("p"))
    whole = reps.where((F.col("rep") != F.col("last")) & (F.col("n_words") >= least_words)).select("h", F.lit(0).cast("long").alias("start_word"), "n_words", F.struct(F.col("rep").alias("partner_doc_id"), F.lit(1.0).alias("similarity")).alias("p"), "last")
    passages = work.put(passages.withColumn("last", F.lit(None).cast("long")).unionByName(whole), "passages")
    work.only(rows, passages)
    out = rows.select("doc_id", "h").join(passages, "h")
    own = (F.col("doc_id") == F.col("p.partner_doc_id")) & F.col("last").isNotNull()
    return out.select("doc_id", "start_word", "n_words", F.when(own, F.col("last")).otherwise(F.col("p.partner_doc_id")).alias("partner_doc_id"), F.col("p.similarity").alias("similarity"))
