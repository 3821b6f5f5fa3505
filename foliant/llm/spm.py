"""Exact encoding and decoding with a merge-type sentencepiece model, by backtracking.

A text is cut before every run of word marks: no piece holds a mark after another character, so no merge
crosses there. A unit is encoded from left to right with the longest piece that an Aho-Corasick automaton
finds at each position; a piece stands only if it is compatible with the one before it, that is if re-merging
the two would not join across their border; else a shorter prefix is tried, and where none fits, a bit marks
the position as failed and the last piece is taken back. Pieces that equal in score (runs of marks) have no
order among themselves, so units with such runs are merged outright, best score first and then leftmost.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
INFINITE = float("inf")


class PieceModel:
    """Vocabulary of a model file: ids, ranks (lower merges first), spines and the automaton."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.skip = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.skip and i not in self.bytes}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.known = {p for p in self.ids if len(p) == 1}
        self.right: dict[str, list[tuple[str, float]]] = {}
        self.left: dict[str, list[tuple[str, float]]] = {}
        self.prefix: dict[str, str] = {}
        self.joins: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        usable = [p for p in self.ids if p.count(MARK) < 2 and self._spines(p)]
        for p in usable:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        held = set(usable)
        for p in usable:
            for k in range(len(p) - 1, 0, -1):
                if p[:k] in held:
                    self.prefix[p] = p[:k]
                    break

    def _spines(self, piece: str) -> bool:
        """Replay the merges of a piece; False if they don't end in the piece itself, which then never occurs."""
        parts: list[tuple] = [(c,) for c in piece]
        while len(parts) > 1:
            best, at = min(((self.rank.get(a[0] + b[0], INFINITE), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best == INFINITE:
                return False
            parts[at : at + 2] = [(parts[at][0] + parts[at + 1][0], parts[at], parts[at + 1])]
        for spines, side in ((self.right, 2), (self.left, 1)):
            node, above, spine = parts[0], INFINITE, []
            while True:
                spine.append((node[0], above))
                if len(node) == 1:
                    break
                above, node = self.rank[node[0]], node[side]
            spines[piece] = spine
        return True

    def compatible(self, a: str, b: str) -> bool:
        """False if merging a and b together would join pieces across their border before a and b are whole."""
        known = self.joins.get((a, b))
        if known is None:
            rank = self.rank
            known = True
            for x, above_x in self.right[a]:
                for y, above_y in self.left[b]:
                    r = rank.get(x + y)
                    if r is not None and r < above_x and r <= above_y:
                        known = False
                        break
                if not known:
                    break
            if len(self.joins) > 500_000:
                self.joins.clear()
            self.joins[a, b] = known
        return known

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text of known characters, without runs of marks."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, piece in self.automaton.iter(text):
            longest[end + 1 - len(piece)] = piece if len(piece) > len(longest[end + 1 - len(piece)] or "") else longest[end + 1 - len(piece)]
        failed = bytearray(n // 8 + 1)
        chosen: list[str] = []
        at, piece = 0, longest[0]
        while at < n:
            end = at + len(piece)
            if not failed[end >> 3] & (1 << (end & 7)) and (not chosen or self.compatible(chosen[-1], piece)):
                chosen.append(piece)
                at = end
                piece = longest[at] if at < n else ""
            elif (shorter := self.prefix.get(piece)) is not None:
                piece = shorter
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = chosen.pop()
                at -= len(piece)
        return [self.ids[p] for p in chosen]

    def merge(self, text: str) -> list[int]:
        """Ids by merging outright: best score first, leftmost among equals."""
        parts: list[str] = list(text)
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, str, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (r := self.rank.get(parts[i] + parts[j])) is not None:
                heapq.heappush(agenda, (r, i, parts[i] + parts[j], j))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, whole, j = heapq.heappop(agenda)
            if not parts[i] or not parts[j] or after[i] != j or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [self.ids[p] for p in parts if p]

    def encode_unit(self, unit: str) -> list[int]:
        out: list[int] = []
        known, run = self.known, 0
        whole = self.merge if MARK * 2 in unit else self.backtrack
        if known.issuperset(unit):
            return whole(unit)
        for i, c in enumerate(unit):
            if c not in known:
                if run < i:
                    out += whole(unit[run:i])
                out += [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
                run = i + 1
        return out + (whole(unit[run:]) if run < len(unit) else [])

    def units(self, text: str) -> list[str]:
        return UNITS.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units(text) for i in self.encode_unit(u)]

    def surface(self, ids: list[int]) -> str:
        """Text of ids, with the marks still in it; runs of byte pieces are UTF-8, and each stray byte is U+FFFD."""
        out: list[str] = []
        held = bytearray()

        def flush() -> None:
            i = 0
            while i < len(held):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(held[i : i + k].decode())
                        i += k
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            held.clear()

        for i in ids:
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                flush()
            if i not in self.skip:
                out.append(self.pieces[i])
        if held:
            flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        return (text[1:] if text.startswith(MARK) else text).replace(MARK, " ")


@lru_cache(2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


class UnitCache:
    """What frequent units encode and decode to, in two generations of bounded size."""

    def __init__(self, model: PieceModel, most: int = 200_000):
        self.model, self.most = model, most
        self.young: dict[str, str | tuple[str, str]] = {}
        self.old: dict[str, str | tuple[str, str]] = {}

    def miss(self, unit: str) -> str | tuple[str, str]:
        value = self.old.get(unit)
        if value is None:
            ids = self.model.encode_unit(unit)
            said, back = "," + ",".join(map(str, ids)), self.model.surface(ids)
            value = said if back == unit else (said, back)
        if len(unit) <= 64:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[unit] = value
        return value

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, sha256 of the ids, sha256 of the decoded text)."""
        units, miss = self.model.units(text), self.miss
        got = [self.young.get(u) or miss(u) for u in units]
        if str in (kinds := set(map(type, got))) and len(kinds) == 1:
            said, back = "".join(got), "".join(units)
        else:
            said = "".join([g if type(g) is str else g[0] for g in got])
            back = "".join([u if type(g) is str else g[1] for u, g in zip(units, got)])
        back = (back[1:] if back.startswith(MARK) else back).replace(MARK, " ")
        return said.count(","), hashlib.sha256(said[1:].encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()


@lru_cache(2)
def unit_cache(path: str) -> UnitCache:
    """One for all tasks that a worker runs."""
    return UnitCache(load(path))


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """One row per document with digests of its ids and of the text that they decode to.

    Null is as empty: no ids; a row without a doc_id is encoded as any other. Texts of any length are encoded whole, unit by unit. Repeated rows are encoded one by one;
    other columns are not read, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = unit_cache(model_path)
        for batch in batches:
            rows = [cache.digest(t.as_py() or "") for t in batch.column(1)]
            if rows:
                n, ids, back = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, SCHEMA)
