"""Vectors in Arrow batches, bounded samples of them, and k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as doubles) for each length; vectors that are null, empty or not finite are left out."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(column.value_lengths().fill_null(0))
    for n in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        finite = np.isfinite(x).all(axis=1)  # a null component reads as NaN
        yield rows[finite], x[finite]


def fitted(x: np.ndarray, dim: int) -> np.ndarray:
    """The first ``dim`` components, with zeros for those that are missing.

    Two vectors of one length are at least as far from each other as what is
    left of them, so bounds on these distances hold for vectors of any length.
    """
    return x[:, :dim] if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def sample_vectors(rows: DataFrame, column: str, most: int) -> tuple[np.ndarray, int]:
    """(about ``most`` different vectors by a hash of their components, or all if there are fewer; how many there are).

    Of the most frequent length only. Repeated vectors count once, so the
    sample is bounded whatever is repeated.
    """
    known = rows.select(F.col(column).cast("array<double>").alias("x")).where("size(x) > 0")
    known = known.where(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).withColumn("h", F.xxhash64("x"))
    n = known.select(F.approx_count_distinct("h", 0.02)).first()[0]
    if n > most:
        known = known.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * most / n))
    found = [r.x for r in known.groupBy("h").agg(F.first("x").alias("x")).orderBy("h").collect()]  # about ``most`` rows
    if not found:
        return np.zeros((0, 0)), 0
    lengths = np.array([len(x) for x in found])
    dim = np.bincount(lengths).argmax()
    return np.array([x for x in found if len(x) == dim]), n


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows."""
    d = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)
    return np.sqrt(np.maximum(d, 0))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k centres, or as many as there are different rows if these are fewer."""
    rows = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:k]]
    for _ in range(rounds):
        near = distances(x, centres).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres
