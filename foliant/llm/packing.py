"""Best-fit packing of tokenized documents into sequences of a fixed length.

Bounded-space online best-fit: every task keeps a fixed number of open bins, in buckets keyed by their free
space with one bit per key, and puts each piece into the bin with the least free space that still holds it.
When all bins are open and none fits, the fullest one closes. Tasks never exchange rows, so packing adds no
shuffle and a lost task repeats only itself; each task leaves at most `open_bins` bins part-filled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from foliant.workspace import small_batches

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Text of a special token, which `tokenizers` takes as one id wherever it occurs.
SPECIAL = "<|endoftext|>"
#: A run of white space that the pattern matcher of the fast form may give up on: it backtracks once a character and
#: stops for good at a million. Texts with a tenth of that go to `tokenizers`.
SAFE_RUN = 100_000
LONG_RUN = re.compile(r"\s{1000,}")


class OpenBins:
    """Best-fit over at most `most` open bins; ids count up from 0."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        one = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.open -= 1
        return one

    def _add(self, one: int, free: int) -> None:
        if free:
            held = self.by_free[free]
            if not held:
                self.bits |= 1 << free
            held.append(one)
            self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it of a piece of this length."""
        if fitting := self.bits >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            one = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            one, free = self.made, self.capacity
            self.made += 1
        self._add(one, free - length)
        return one, self.capacity - free


class Encoder:
    """Ids as `tokenizers` gives them for a byte-level file, by the same vocabulary as ranks where that is exact."""

    def __init__(self, json_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        # A match takes a run whole, so that looking for them stays linear.
        if self.fast is None or SPECIAL in text or len(text) >= SAFE_RUN and any(m.end() - m.start() >= SAFE_RUN for m in LONG_RUN.finditer(text)):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cut(n: int, size: int) -> Iterable[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only what exceeds `size` is cut, and the first piece takes the remainder."""
    first = n % size or size
    yield 0, min(n, first)
    for start in range(first, n, size):
        yield start, size


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, *, size: int = 2048, open_bins: int = 256, end_id: int = 0) -> DataFrame:
    """One row per piece of every document, with its sequence and its place there.

    Null and empty texts are one piece with the end id alone. Repeated doc_id rows are packed one by one, and a null
    doc_id stays null. A text of any length is encoded whole, and only texts over `size` ids are cut; pieces of equal
    length go to the bin last used among those of equal free space. Columns besides doc_id and text are not read. An
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = Encoder(json_path, ranks_path), OpenBins(size, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc, text in zip(ids_of, texts):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), size)):
                    one, offset = bins.place(length)
                    out.append((doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), base + one, offset))
            if out:
                doc, piece, *longs = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in longs)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
                )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, SCHEMA)
