"""Quality by random Fourier features, ridge regression and isotonic calibration (operator 5)."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import releasing, text_parts, with_column
from weftline.llm.labels import labelled_sample, one_each, part
from weftline.plans.stages import Stages

#: Random features, bins of the calibration, and tasks whose sums the driver adds (0.7 MB each).
FEATURES, BINS, TASKS = 256, 512, 16
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"$%&*#@+=<>^~_\\/{}[]", b"\"'`()-:;", bytes(range(128, 256))]
_GROUP = np.full(256, len(_GROUPS))
for _i, _group in enumerate(_GROUPS):
    _GROUP[list(_group)] = _i


def statistics(text: str) -> list[float]:
    """What a text looks like: shares of kinds of bytes, words, repetition, lines."""
    data = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_GROUP, weights=np.bincount(data, minlength=256), minlength=len(_GROUPS) + 1)
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    times = Counter(words)
    lines = text.split("\n")
    return [
        *(kinds / max(1, len(data))),
        np.log1p(len(words)),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        (lengths <= 3).sum() / n,
        len(times) / n,
        len(times) / np.sqrt(n),
        max(times.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        np.log1p(n / (1 + kinds[5])),
        sum(map(str.isupper, words)) / n,
    ]


WIDTH = len(statistics(""))


@dataclass
class QualityModel:
    """Means and scales of the statistics, the random features, ridge weights, and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return _fourier((x - self.mean) / self.scale)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.zeros(len(x))
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def _fourier(x: np.ndarray) -> np.ndarray:
    """Cosines whose products approximate a Gaussian kernel as wide as the root of the dimension, and a constant."""
    rng = np.random.default_rng(5)
    w = rng.standard_normal((WIDTH, FEATURES)) / np.sqrt(WIDTH)
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.sqrt(2 / FEATURES) * np.cos(np.clip(x, -6, 6) @ w + shift)
    return np.column_stack([z, np.ones(len(x))])


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to the means y with weights n (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, n, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _held(pick: str) -> Column:
    """The fifth of a sample that calibrates."""
    return F.pmod(F.xxhash64(pick, F.lit(5)), F.lit(5)) == 0


def _ridge(total: np.ndarray, ridge: float) -> np.ndarray:
    """Weights from the sums z'z, the last row of which is z'y."""
    size = total.shape[1]
    n = max(total[size - 1, size - 1], 1.0)
    return np.linalg.solve(total[:size] + ridge * n * np.eye(size) / FEATURES, total[size])


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, *, target="quality", most=40_000, ridge=1e-3) -> QualityModel:
    """Learned from a sample of about ``most`` labelled rows for which ``train`` holds.

    The statistics of the sample are computed where the texts are read and
    staged. Each of a fixed number of tasks sums its normal equations, the
    driver adds and solves them. A fifth of the sample, held out from a first
    solution, calibrates by counts in bins; the final weights are of all rows.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    sample = labelled_sample(docs, labels, target, train, most)
    rows = stages.write(one_each(sample.mapInArrow(_sample_statistics, "y int, pick long, hash long, x array<double>"), "x"))
    moments = rows.select([F.avg(F.col("x")[i]) for i in range(WIDTH)] + [F.stddev_pop(F.col("x")[i]) for i in range(WIDTH)]).first()
    if moments[0] is None:
        stages.drop(rows)
        return QualityModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    mean, scale = np.array(moments[:WIDTH]), np.array(moments[WIDTH:])
    model = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0))
    size = FEATURES + 1
    sums = rows.select("y", "x", _held("pick").alias("held")).coalesce(TASKS).mapInArrow(partial(_normal_equations, model=model), "held boolean, sums binary")
    total = {True: np.zeros((size + 1, size)), False: np.zeros((size + 1, size))}
    for row in sums.collect():
        total[row.held] += np.frombuffer(row.sums).reshape(size + 1, size)
    model.weights = _ridge(total[False], ridge)  # the calibration sees scores of rows that these weights were not learned from
    bins = (
        rows.where(_held("pick")).mapInArrow(partial(_raw_scores, model=model), "y int, raw double")
        .groupBy(F.floor(F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) * BINS).alias("bin"))
        .agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n"))
        .orderBy("bin")
        .collect()
    )
    model.weights = _ridge(total[False] + total[True], ridge)
    raw, y, n = (np.array([float(r[k]) for r in bins]) for k in ("raw", "y", "n"))
    if not len(raw):  # hardly any rows: the mean is the score
        raw, y, n = (np.array([v]) for v in (0.0, rows.agg(F.avg("y")).first()[0], 1.0))
    level = isotonic(y, n)
    ends = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [len(level)]])
    model.knots = np.array([np.average(raw[a:b], weights=n[a:b]) for a, b in zip(ends, ends[1:], strict=False)])
    model.values = level[ends[:-1]]
    stages.drop(rows)
    return model


def score_quality(docs: DataFrame, model: QualityModel, *, text_col="text", score_col="score") -> DataFrame:
    """``docs`` with the score of every whole text; 0 where nothing was learned.

    A null text counts as an empty one, which is scored by its statistics like
    any other. Rows are independent: repeated rows, repeated ids and null ids
    return as they came; other columns pass through under any names, but one
    named like the score is replaced. Whole texts are read, about 1 MB or one text
    at a time. An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return with_column(docs, score_col, "double", partial(_scorer, held), text_col=text_col)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): labels of rows with part(4) = 2 are not learned from."""
    model = fit_quality(docs, labels, part(4) != 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score_quality(rows, model).select(
        "doc_id",
        F.coalesce(part(4) == 2, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@releasing
def _sample_statistics(batches):
    for batch in batches:
        x = [statistics(t) for _, _, texts in text_parts(batch, "text", 1 << 20) for t in texts]
        own = [batch.column(c) for c in ("y", "pick", "hash")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(x, pa.list_(pa.float64()))], ["y", "pick", "hash", "x"])


def _matrix(batch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


@releasing
def _normal_equations(batches, model):
    total = np.zeros((2, FEATURES + 2, FEATURES + 1))
    for batch in batches:
        z, y = model.features(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False)
        held = batch.column("held").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            own = z[held == bool(k)]
            total[k, :-1] += own.T @ own
            total[k, -1] += own.T @ y[held == bool(k)]
    yield pa.RecordBatch.from_arrays([pa.array([False, True]), pa.array([x.tobytes() for x in total], pa.binary())], ["held", "sums"])


@releasing
def _raw_scores(batches, model):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(model.raw(_matrix(batch)))], ["y", "raw"])


def _scorer(held):
    def compute(texts):
        return held.value.score(np.array([statistics(t) for t in texts]).reshape(-1, WIDTH))

    return compute
