"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams (operator 3)."""

from __future__ import annotations

import string
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WordHashes, mix, pack, releasing, take, text_parts, unpack, with_column
from weftline.llm.labels import labelled_sample, one_each, part

BITS = 20  # of a feature: 4 MiB of weights are broadcast, whatever the data
BIAS = 0
START = 4  # letters of a word's beginning
_STRIP = string.punctuation + string.whitespace


class _Words(WordHashes):
    """Hashes of words without the punctuation around them."""

    def __missing__(self, word: str) -> int:
        value = WordHashes.__missing__(self, word.strip(_STRIP))
        self[word] = value
        return value


class _Starts(WordHashes):
    """Hashes of the first letters of words."""

    def __missing__(self, word: str) -> int:
        value = WordHashes.__missing__(self, "^" + word.strip(_STRIP)[:START])
        self[word] = value
        return value


class Features:
    """Hashed features: words, their first letters, pairs of neighbours, pairs with one or two words between."""

    def __init__(self):
        self.words, self.starts = _Words(), _Starts()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, feature) of every occurrence."""
        word, offsets = self.words.of(texts)
        start, _ = self.starts.of(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        ids, at = [mix(word), mix(start + np.uint64(11))], [text, text]
        for gap in (1, 2, 3):
            both = text[gap:] == text[:-gap] if len(text) > gap else np.zeros(0, bool)
            pair = mix(word[: len(both)] + np.uint64(gap)) + word[gap:] if len(both) else word[:0]
            ids.append(mix(pair)[both])
            at.append(text[: len(both)][both])
        index = (np.concatenate(ids) >> np.uint64(64 - BITS)).astype(np.int64)
        index[index == BIAS] = 1
        return np.concatenate(at), index


class Ftrl:
    """FTRL-proximal: a learning rate for each coordinate, and L1 that leaves most weights at 0."""

    def __init__(self, alpha=0.5, beta=1.0, l1=8.0, l2=0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, i=slice(None)) -> np.ndarray:
        z = self.z[i]
        small = np.abs(z) <= self.l1
        return np.where(small, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, y: int) -> None:
        """One row whose present features are i, each once."""
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def calibration(score: np.ndarray, y: np.ndarray, prior: float = 5.0) -> tuple[float, float]:
    """(a, b) of the logistic curve 1 / (1 + exp(-(a * score + b))) that fits labels best, with smoothed targets.

    A penalty of ``prior`` holds them near (1, 0), which few rows hardly move.
    """
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, start = np.column_stack([score, np.ones(len(score))]), np.array([1.0, 0.0])
    found = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -35, 35)))
        slope = x.T @ (p - t) + prior * (found - start)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + prior * np.eye(2), slope)
        found -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(np.clip(found[0], 0.5, 2)), float(np.clip(found[1], -2, 2))


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, *, target="toxic", most=16_384, rounds=6) -> np.ndarray:
    """Weights of the features, learned from a sample of about ``most`` rows for which ``train`` holds.

    Features are extracted where the texts are read; one task learns from the
    sample, whose size ``most`` bounds. A fifth of the sample, held out from a
    first model, calibrates the scores; the second model learns from all of it.
    All zeros if there is nothing to learn from.
    """
    sample = labelled_sample(docs, labels, target, train, most)
    features = one_each(sample.mapInArrow(_features, "y int, pick long, hash long, features binary"), "features")
    learned = features.repartition(1).sortWithinPartitions("pick", "y").mapInArrow(
        partial(_learn, rounds=rounds), "feature int, weight double"
    )
    out = np.zeros(1 << BITS, np.float32)
    for row in learned.collect():  # 2 ** BITS rows at most, and L1 leaves few
        out[row.feature] = row.weight
    return out


def score_toxicity(docs: DataFrame, weights: np.ndarray, *, text_col="text", score_col="score") -> DataFrame:
    """``docs`` with the score of every whole text; 0 where nothing was learned.

    A null text counts as an empty one, which gets the score of no features.
    Rows are independent: repeated rows, repeated ids and null ids return as
    they came; other columns pass through under any names, but one named like
    the score is replaced. Whole texts are read, about 1 MB or one text at a time.
    An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)
    return with_column(docs, score_col, "double", partial(_scorer, held), text_col=text_col)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): labels of rows with part(5) = 0 are not learned from."""
    weights = fit_toxicity(docs, labels, part(5) != 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score_toxicity(rows, weights).select(
        "doc_id",
        F.coalesce(part(5) == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@releasing
def _features(batches):
    make = Features()
    for batch in batches:
        for lo, hi, texts in text_parts(batch, "text", 1 << 20):
            at, index = make.of(texts)
            found = np.unique(at << BITS | index)
            at, index = found >> BITS, (found & ((1 << BITS) - 1)).astype(np.uint32)
            ends = np.searchsorted(at, np.arange(hi - lo + 1))
            rows = [pack(np.diff(index[a:b], prepend=np.uint32(0)).tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
            own = [batch.column(c).slice(lo, hi - lo) for c in ("y", "pick", "hash")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(rows, pa.binary())], ["y", "pick", "hash", "features"])


def _present(data: bytes) -> np.ndarray:
    """The features of a row, which stay packed in memory."""
    return np.concatenate([[BIAS], np.cumsum(np.frombuffer(unpack(data), np.uint32), dtype=np.int64)])


def _fit(model: Ftrl, use, rows, ys, rounds: int) -> None:
    for _ in range(rounds):
        for k in use:
            model.learn(_present(rows[k]), ys[k])


@releasing
def _learn(batches, rounds):
    rows, ys = [], []
    for batch in batches:
        rows += batch.column("features").to_pylist()
        ys += take(batch, "y").tolist()
    if not rows:
        return
    y = np.array(ys)
    first, held = Ftrl(), range(0, len(rows), 5)
    _fit(first, [k for k in range(len(rows)) if k % 5], rows, ys, rounds)
    w = first.weights()
    scale, shift = calibration(np.array([w[_present(rows[k])].sum() for k in held]), y[::5])
    model = Ftrl()
    _fit(model, range(len(rows)), rows, ys, rounds)
    w = scale * model.weights()
    w[BIAS] += shift
    i = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(w[i])], ["feature", "weight"])


def _scorer(held):
    w, make = held.value, Features()
    learned = bool(w.any())

    def compute(texts):
        at, index = make.of(texts)
        some = np.flatnonzero(w[index])
        found = np.unique(at[some] << BITS | index[some])  # presence counts, not frequency
        total = float(w[BIAS]) + np.bincount(found >> BITS, weights=w[found & ((1 << BITS) - 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -35, 35))) if learned else np.zeros(len(texts))

    return compute
