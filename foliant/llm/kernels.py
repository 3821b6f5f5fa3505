"""Vectorised text kernels: words, hashes and shingles of whole texts, straight from Arrow buffers.

A word is a maximal run of the bytes that a table of 256 marks admits. Hashes are polynomials modulo
2**64 read off one prefix sum, so that the hash of any byte span costs two lookups, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: Arrays over a block hold several times eight bytes for each of its bytes; at this size most stay in the CPU's cache.
BLOCK_BYTES = 1 << 18

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES
#: Letters, digits and all of UTF-8 beyond ASCII; for models, which see words without punctuation.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _P_INV)):
            step = np.full(n, base, U)
            step[0] = 1
            _powers[i] = np.cumprod(step, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1, from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Block:
    """Consecutive rows with their bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1

    def prefix(self, data: np.ndarray | None = None) -> np.ndarray:
        """Prefix sums of the polynomial hash, one longer than the data."""
        data = self.data if data is None else data
        power, _ = powers(len(data) + 1)
        out = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=out[1:])
        return out

    def spans(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and for each row the index of its first word (rows + 1)."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.rows + 1, np.int64)
        inside = marks[self.data]
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        after = np.zeros(n + 1, bool)
        after[:-1] = inside
        edges = self.offsets
        before[edges] = False
        after[edges] = False
        starts = np.flatnonzero(inside & ~before[:-1])
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        return starts, ends, np.searchsorted(starts, edges)


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def blocks(batch: pa.RecordBatch, text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """The batch in slices of about `most` bytes of text, never less than a row."""
    column = batch.column(batch.schema.get_field_index(text))
    data, offsets = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield batch.slice(row, to - row), Block(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
        row = to


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words in each row, and for each row its first shingle (rows + 1).

    A row with at least one word but fewer than k has one shingle of all its words.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    rows = len(n)
    padded = np.concatenate([words, np.zeros(k, U)])
    full = np.zeros(len(words), U)
    for i in range(k):
        full = full * U(0xD6E8FEB86659FD93) + padded[i : i + len(words)]
    at_word = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    out = full[at_word]
    for r in np.flatnonzero((n > 0) & (n < k)):
        h = 0
        for w in words[first[r] : first[r + 1]]:
            h = (h * 0xD6E8FEB86659FD93 + int(w) + 1) & (2**64 - 1)
        out[at[r]] = h
    return mix(out), at if rows else np.zeros(1, np.int64)


def per_block(batch_fn: Callable[[pa.RecordBatch, Block], pa.RecordBatch | None], text: str = "text") -> Callable:
    """A function for mapInArrow that applies batch_fn to slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch, text):
                out = batch_fn(part, block)
                if out is not None and out.num_rows:
                    yield out

    return run


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values by row, where row r has values first[r] to first[r + 1]."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
