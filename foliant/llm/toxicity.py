"""Convolutional text classifier in numpy: hashed word embeddings, several filter widths, max pooling.

A word's embedding is the sum of the rows of its own hash and of the hashes of its first 4, 5 and 6 bytes,
lower-cased; hashes seen in too few training documents share the zero row. Only text goes into a score; the
language serves to calibrate thresholds, which set the verdict, never the score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm.kernels import LETTERS, LOWER, U, Block, blocks, mix, per_block, span_hash, text_buffers
from foliant.llm.training import fold, labelled_sample

PREFIXES = (4, 5, 6)
WIDTHS = (1, 2, 3)
#: Zero words after each document.
GAP = 2 * (max(WIDTHS) - 1)
SLOT_BITS = 20


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (words x 4) and each row's first word; a prefix that the word doesn't reach is 0."""
    folded = LOWER[block.data]
    prefix = block.prefix(folded)
    starts, ends, first = block.spans(LETTERS)
    out = np.zeros((len(starts), 1 + len(PREFIXES)), U)
    out[:, 0] = span_hash(prefix, starts, ends)
    for i, k in enumerate(PREFIXES):
        to = np.minimum(starts + k, ends)
        out[:, i + 1] = np.where(ends - starts >= k, mix(span_hash(prefix, starts, to) + U(k)), U(0))
    return out, first


class Cnn:
    """Embedding table, filters of each width, output weights; `slots` finds a hash's row."""

    def __init__(self, vocabulary: np.ndarray, size: int = 8, filters: int = 6, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hashes = np.concatenate([np.zeros(1, U), vocabulary])
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.slots[(self.hashes[::-1] & U((1 << SLOT_BITS) - 1)).astype(np.int64)] = np.arange(len(self.hashes))[::-1]
        self.slots[0] = 0
        self.table = rng.normal(0, 0.1, (len(self.hashes), size)).astype(np.float32)
        self.table[0] = 0
        self.filters = [rng.normal(0, 0.5, (w, size, filters)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(filters, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * filters).astype(np.float32)
        self.bias = np.float32(0)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        found = self.slots[(hashes & U((1 << SLOT_BITS) - 1)).astype(np.int64)]
        return np.where(self.hashes[found] == hashes, found, 0)

    def pooled(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Pooled activations of each document, and the convolution's values before pooling."""
        n, docs = len(rows), len(first) - 1
        # After each document stand zero words for the filters that begin in it or reach in from the last of its own.
        at = np.arange(n) + np.repeat(np.arange(docs), np.diff(first)) * GAP
        words = np.zeros((n + docs * GAP, self.table.shape[1]), np.float32)
        words[at] = self.table[rows[:, 0]]
        for i in range(1, rows.shape[1]):
            words[at] += self.table[rows[:, i]]
        starts = first[:-1] + np.arange(docs) * GAP
        spans = np.stack([starts, starts + np.diff(first) + GAP // 2], 1).ravel()  # half of the zeros belong to the pooling
        values, pooled = [], []
        for filters, bias in zip(self.filters, self.biases):
            made = words @ filters[0]
            for j in range(1, len(filters)):
                made[:-j] += (words @ filters[j])[j:]
            made += bias
            values.append(made)
            pooled.append(np.maximum.reduceat(made, spans, axis=0)[::2] if docs else np.zeros((0, filters.shape[2]), np.float32))
        return np.maximum(np.concatenate(pooled, axis=1), 0), values, words

    def scores(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        pooled, _, _ = self.pooled(rows, first)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30)))

    def train(self, rows: np.ndarray, first: np.ndarray, labels: np.ndarray, keep: np.ndarray, *, epochs: int = 8, batch: int = 32, rate: float = 0.08, seed: int = 7) -> None:
        """Adagrad on the logistic loss of the documents in keep; gradients reach only the words that won the pooling."""
        rng = np.random.default_rng(seed)
        size = self.table.shape[1]
        squares = [np.full_like(x, 1e-3) for x in (self.table, *self.filters, *self.biases, self.out)]
        bias_square = 1e-3

        def step(x, grad, square, at=slice(None)):
            square[at] += grad**2
            x[at] -= rate * grad / np.sqrt(square[at])

        for _ in range(epochs):
            order = rng.permutation(keep)
            for k in range(0, len(order), batch):
                docs = order[k : k + batch]
                lengths = first[docs + 1] - first[docs]
                own = np.concatenate([[0], np.cumsum(lengths)])
                picked = rows[np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])] if own[-1] else rows[:0]
                pooled, values, words = self.pooled(picked, own)
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30)))
                error = ((p - labels[docs]) / len(docs)).astype(np.float32)
                on = error[:, None] * self.out[None, :] * (pooled > 0)
                grad_out = error @ pooled + 1e-4 * self.out
                starts = own[:-1] + np.arange(len(docs)) * GAP
                touched = np.zeros_like(words)
                filter_grads = [np.zeros_like(f) for f in self.filters]
                bias_grads = [np.zeros_like(b) for b in self.biases]
                n = self.filters[0].shape[2]
                for w, (f, made) in enumerate(zip(self.filters, values)):
                    for d, s in enumerate(starts):
                        g = on[d, w * n : (w + 1) * n]
                        if not g.any():
                            continue
                        # The pooling of a document spans its words and the zero words after them.
                        best = made[s : s + lengths[d] + GAP // 2].argmax(axis=0) + s
                        bias_grads[w] += g
                        for j in range(len(f)):
                            reach = np.minimum(best + j, len(words) - 1)
                            filter_grads[w][j] += words[reach].T * g
                            np.add.at(touched, reach, g[:, None] * f[j].T)
                at = np.arange(own[-1]) + np.repeat(np.arange(len(docs)), lengths) * GAP
                hit = np.flatnonzero(touched[at].any(axis=1))
                grads = np.repeat(touched[at[hit]], rows.shape[1], axis=0)
                ids, inverse = np.unique(picked[hit].ravel(), return_inverse=True)
                summed = np.zeros((len(ids), size), np.float32)
                np.add.at(summed, inverse, grads)
                summed[ids == 0] = 0
                step(self.table, summed, squares[0], ids)
                for i, g in enumerate((*filter_grads, *bias_grads, grad_out)):
                    step((*self.filters, *self.biases, self.out)[i], g, squares[i + 1])
                bias_square += float(error.sum()) ** 2
                self.bias -= np.float32(rate * error.sum() / bias_square**0.5)


class Classifier:
    """A trained network with a threshold for each language."""

    def __init__(self, sample: list[tuple[int, str, str, float]], *, least_docs: int = 4, wanted_precision: float = 0.98):
        self.net, self.thresholds = Cnn(np.zeros(0, U)), {}
        if not sample:
            return
        labels = np.array([s[3] > 0 for s in sample], np.float32)
        # In parts, so that the hashes of all words are never held at once.
        parts = [pa.array([s[2] for s in sample[k : k + 200]]) for k in range(0, len(sample), 200)]
        distinct = []
        for part in parts:
            hashes, own = features(Block(*text_buffers(part)))
            distinct += [np.unique(hashes[a:b]) for a, b in zip(own, own[1:])]
        seen, counts = np.unique(np.concatenate(distinct), return_counts=True)
        del distinct
        frequent = np.argsort(-counts[counts >= least_docs], kind="stable")
        vocabulary = seen[counts >= least_docs][frequent]
        self.net = Cnn(vocabulary[vocabulary != 0])
        found, lengths = [], []
        for part in parts:
            hashes, own = features(Block(*text_buffers(part)))
            found.append(self.net.rows(hashes).astype(np.int32))
            lengths.append(np.diff(own))
        rows, first = np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        del found
        aside = np.arange(len(sample)) % 6 == 5
        self.net.train(rows, first, labels, np.flatnonzero(~aside))
        scores = np.concatenate([self.net.scores(rows[first[k] : first[min(k + 200, len(labels))]], first[k : k + 201] - first[k]) for k in range(0, len(labels), 200)])
        langs = np.array([s[1] or "" for s in sample])
        for lang in np.unique(langs):
            own = aside & (langs == lang)
            self.thresholds[str(lang)] = self._threshold(scores[own], labels[own] > 0, wanted_precision)

    @staticmethod
    def _threshold(scores: np.ndarray, toxic: np.ndarray, precision: float) -> float:
        """Halfway between the classes at the lowest cut of that precision; 0.5 with under 10 toxic documents."""
        if toxic.sum() < 10 or toxic.all():
            return 0.5
        order = np.argsort(-scores)
        right = np.cumsum(toxic[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero((right >= precision) & toxic[order])
        if not len(good):
            return 0.5
        last = good[-1]
        below = scores[order[last + 1]] if last + 1 < len(order) else 0.0
        return float(np.clip((scores[order[last]] + below) / 2, 0.2, 0.9))

    def score(self, block: Block) -> np.ndarray:
        hashes, first = features(block)
        return self.net.scores(self.net.rows(hashes), first).astype(float)


def fit(docs: DataFrame, labels: DataFrame, *, most: int = 3000) -> Classifier:
    """Trained on at most about `most` documents of either label, never on the held-out fold."""
    return Classifier(labelled_sample(docs, labels, "toxic", most))


def rejection(model):
    """A column function of (text, lang): whether the score reaches the threshold of the language."""

    @F.pandas_udf("boolean")
    def reject(text: pd.Series, lang: pd.Series) -> pd.Series:
        out = np.zeros(len(text), bool)
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string(), from_pandas=True)], ["text"])
        cut = np.array([model.value.thresholds.get(x or "", 0.5) for x in lang])
        at = 0
        for part, block in blocks(batch):
            out[at : at + block.rows] = model.value.score(block) >= cut[at : at + block.rows]
            at += block.rows
        return pd.Series(out)

    return reject


def classify(docs: DataFrame, labels: DataFrame, *, most: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted, rejected: one row per row of docs.

    `rejected` applies the threshold of the row's language (0.5 for one without a threshold). Null and empty
    texts score as a text without words; without labels every score is that of an untrained network at about 0.5.
    Repeated rows score alike, ties at a threshold are rejected, texts of any length are read whole, and an empty table
    gives an empty result. Columns besides doc_id, text and lang are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most=most))

    def one(part: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        score = model.value.score(block)
        cut = np.array([model.value.thresholds.get(x or "", 0.5) for x in part.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(score >= cut)], ["doc_id", "score", "rejected"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", lang, "text").mapInArrow(per_block(one), f"doc_id {kind}, score double, rejected boolean")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "rejected")
