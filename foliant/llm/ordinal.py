"""Ordinal quality regression: cumulative links over shared hashed-text weights with ordered thresholds.

P(grade > k) = sigmoid(w . x - theta_k) with theta increasing; x holds, for each hash bucket, the share of the
text's words that fall into it: the word itself, the character classes of its two ends, and whether it repeats
the word before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm.kernels import NOT_SPACE, U, Block, blocks, mix, per_block, row_sums, span_hash, text_buffers
from foliant.llm.training import fold, labelled_sample

BITS = 17
CLASSES = np.arange(256, dtype=np.uint8)
CLASSES[0x30:0x3A], CLASSES[0x41:0x5B], CLASSES[0x61:0x7B], CLASSES[0x80:] = 0x30, 0x41, 0x61, 0x61


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words x 4) and each row's first word."""
    starts, ends, first = block.spans(NOT_SPACE)
    words = span_hash(block.prefix(), starts, ends)
    shape = block.prefix(CLASSES[block.data])
    head = span_hash(shape, starts, np.minimum(starts + 2, ends)) + U(1)
    tail = span_hash(shape, np.maximum(ends - 3, starts), ends) + U(2)
    repeats = np.zeros(len(words), U)
    repeats[1:] = words[1:] == words[:-1]
    repeats[first[:-1][first[:-1] < len(words)]] = 0
    out = np.stack([words, mix(head), mix(tail), mix(repeats + U(3))], 1)
    return (out & U((1 << BITS) - 1)).astype(np.int32), first


class CumulativeLink:
    """Grades, their ordered thresholds and the weights by bucket."""

    def __init__(self, sample: list[tuple[int, str, str, float]], *, epochs: int = 12, batch: int = 64, rate: float = 0.5, decay: float = 1e-6, seed: int = 5):
        self.weights = np.zeros(1 << BITS, np.float64)
        self.grades = np.array(sorted({s[3] for s in sample}) or [0.0])
        self.thresholds = np.zeros(len(self.grades) - 1)
        if len(self.grades) < 2:
            return
        rng = np.random.default_rng(seed)
        found = [features(Block(*text_buffers(pa.array([s[2] for s in sample[j : j + 200]])))) for j in range(0, len(sample), 200)]
        buckets, first = np.concatenate([f[0] for f in found]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f[1]) for f in found]))])
        del found
        grade = np.searchsorted(self.grades, [s[3] for s in sample])
        k = len(self.thresholds)
        base, steps = np.full(1, -1.0), np.zeros(k - 1)
        squares, t_square = np.full(1 << BITS, 1e-4), np.full(k, 1e-2)
        # A rarer grade weighs more, so that each counts alike.
        weight = (len(sample) / (len(self.grades) * np.bincount(grade, minlength=len(self.grades))))[grade]
        for _ in range(epochs):
            for docs in np.array_split(order := rng.permutation(len(sample)), max(1, len(order) // batch)):
                at = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
                n = np.maximum(first[docs + 1] - first[docs], 1)
                row = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
                own = buckets[at]
                raw = np.bincount(row, self.weights[own].sum(1), len(docs)) / n
                theta = np.concatenate([base, base + np.cumsum(np.exp(steps))])
                p = 1 / (1 + np.exp(-np.clip(raw[:, None] - theta[None, :], -30, 30)))
                error = (p - (grade[docs][:, None] > np.arange(k)[None, :])) * weight[docs][:, None] / len(docs)
                per_word = (error.sum(1) / n)[row]
                ids, inverse = np.unique(own.ravel(), return_inverse=True)
                grad = np.bincount(inverse, np.repeat(per_word, own.shape[1])) + decay * self.weights[ids]
                squares[ids] += grad**2
                self.weights[ids] -= rate * grad / np.sqrt(squares[ids])
                down = -error.sum(0)
                tail = np.cumsum(down[::-1])[::-1]
                moves = np.concatenate([[down.sum()], tail[1:] * np.exp(steps)])
                t_square += moves**2
                moved = 0.1 * moves / np.sqrt(t_square)
                base -= moved[:1]
                steps -= moved[1:]
        self.thresholds = np.concatenate([base, base + np.cumsum(np.exp(steps))])

    def tails(self, block: Block) -> np.ndarray:
        """P(grade > each grade but the last), rows x (grades - 1)."""
        buckets, first = features(block)
        total = self.weights[buckets[:, 0]]
        for i in range(1, buckets.shape[1]):
            total = total + self.weights[buckets[:, i]]
        raw = row_sums(total, first) / np.maximum(np.diff(first), 1)
        return 1 / (1 + np.exp(-np.clip(raw[:, None] - self.thresholds[None, :], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, most: int = 2500) -> CumulativeLink:
    """Fitted on at most about `most` documents of each grade, never on the held-out fold."""
    return CumulativeLink(labelled_sample(docs, labels, "quality", most, seed=2))


def tail(model):
    """A column function of text: the probability of reaching the highest grade."""

    @F.pandas_udf("double")
    def probability(text: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string(), from_pandas=True)], ["text"])
        parts = [model.value.tails(block)[:, -1] for _, block in blocks(batch)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return probability


def grade(docs: DataFrame, labels: DataFrame, *, most: int = 2500, least_grade: float | None = None, least_tail: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, kept: one row per row of docs.

    `tail_probability` is that of reaching `least_grade` (the highest grade if None); a row is kept at
    `least_tail` or more. Null and empty texts have no words and rest on the thresholds alone; without labels of
    two grades nothing can be told apart: the tail probability is null and every row is kept. Repeated rows are graded
    alike, ties at `least_tail` are kept, texts of any length are read whole, and an empty table gives an empty result.
    Columns besides doc_id and text are not read.
    """
    fitted = fit(docs, labels, most=most)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    wanted = fitted.grades[-1] if least_grade is None else least_grade
    at = int(np.searchsorted(fitted.grades, wanted)) - 1
    told = len(fitted.thresholds) > 0

    def one(part: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        m = model.value
        tails = m.tails(block)
        expected = m.grades[0] + tails @ np.diff(m.grades)
        tail = tails[:, min(max(at, 0), tails.shape[1] - 1)] if told else np.zeros(block.rows)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(expected), pa.array(tail)], ["doc_id", "expected_grade", "tail_probability"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(per_block(one), f"doc_id {kind}, expected_grade double, tail_probability double")
    tail = F.col("tail_probability") if told else F.lit(None).cast("double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "expected_grade", tail.alias("tail_probability"), F.coalesce(tail >= least_tail, F.lit(True)).alias("kept"))
