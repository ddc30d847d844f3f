import zlib

import numpy as np
import pytest

from tests.llm.fixtures import documents, frame

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.mark.parametrize("name, target, modulus, rest, least", [("toxicity", "toxic", 5, 0, 0.93), ("quality", "quality", 4, 2, 0.95)])
def test_held_out_accuracy(spark, tables, name, target, modulus, rest, least):
    import importlib

    docs, labels = tables
    got = getattr(importlib.import_module(f"weftline.llm.{name}"), name)(docs, labels)
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == rest) for i, r in rows.items())
    known = {r.doc_id: r[target] for r in labels.collect()}
    hits = [rows[i].predicted == y for i, y in known.items() if rows[i].held_out]
    assert np.mean(hits) >= least


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_awkward_rows(spark, name):
    import importlib

    run = getattr(importlib.import_module(f"weftline.llm.{name}"), name)
    docs = frame(spark, documents(), True)
    labels = spark.createDataFrame([(i, k % 2, k % 2) for k, (i, _) in enumerate(documents())] + [(5, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = run(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in documents())
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    assert {r.score for r in run(docs, labels.where("false")).collect()} == {0.0}
    assert run(docs.where("false"), labels).count() == 0


def test_isotonic():
    from weftline.llm.quality import isotonic

    assert isotonic(np.array([0.0, 1.0, 0.0, 1.0]), np.array([1.0, 1.0, 1.0, 1.0])).tolist() == [0.0, 0.5, 0.5, 1.0]
    assert isotonic(np.zeros(0), np.zeros(0)).tolist() == []


def test_ftrl_is_sparse():
    from weftline.llm.toxicity import Ftrl

    model, rng = Ftrl(), np.random.default_rng(0)
    for _ in range(3000):
        y = int(rng.random() < 0.5)
        model.learn(np.array([0, 10 + y, *np.unique(rng.integers(100, 5000, 20))]), y)
    w = model.weights()
    assert w[11] > 0 > w[10] and np.count_nonzero(w) < 400


def plain_ftrl(rows, alpha=0.5, beta=1.0, l1=8.0, l2=0.1, rounds=6):
    """Weights by the definition, a coordinate at a time; rows are (features, label)."""
    import math
    from collections import defaultdict

    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(rounds):
        for features, y in rows:
            w = {i: weight(i) for i in features}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for i in features:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: w for i in z if (w := weight(i))}


def test_toxicity_against_plain_ftrl(spark, tables):
    """The learned weights are those of a plain FTRL over the same rows in the same order, scaled by the calibration."""
    from pyspark.sql import functions as F

    from weftline.llm.labels import labelled_sample
    from weftline.llm.toxicity import BIAS, Features, calibration, fit_toxicity

    docs, labels = tables
    train = F.col("doc_id") % 3 == 1
    sample = labelled_sample(docs, labels, "toxic", train, 10**6).toPandas().sort_values(["pick", "y"])
    make = Features()
    rows = [([BIAS, *np.unique(make.of([t or ""])[1]).tolist()], int(y)) for t, y in zip(sample.text, sample.y, strict=True)]
    first = plain_ftrl([r for k, r in enumerate(rows) if k % 5])
    held = [k for k in range(len(rows)) if k % 5 == 0]
    a, b = calibration(np.array([sum(first.get(i, 0) for i in rows[k][0]) for k in held]), np.array([rows[k][1] for k in held]))
    want = {i: a * w for i, w in plain_ftrl(rows).items()}
    want[BIAS] = want.get(BIAS, 0.0) + b
    got = fit_toxicity(docs, labels, train, most=10**6)
    assert set(np.flatnonzero(got)) == {i for i, w in want.items() if np.float32(w)}
    assert all(abs(got[i] - w) < 1e-4 for i, w in want.items())


def plain_isotonic(y, n):
    """max over starts of min over ends of the means: the definition of the regression."""
    mean = lambda a, b: float(np.average(y[a:b], weights=n[a:b]))
    return [max(min(mean(a, b) for b in range(i + 1, len(y) + 1)) for a in range(i + 1)) for i in range(len(y))]


def test_isotonic_against_the_definition():
    from weftline.llm.quality import isotonic

    rng = np.random.default_rng(6)
    for _ in range(20):
        y, n = rng.random(12), rng.integers(1, 9, 12).astype(float)
        assert np.allclose(isotonic(y, n), plain_isotonic(y, n))


def test_quality_against_plain_ridge(spark, tables):
    """Weights by solving the normal equations in one piece, scores by interpolating the isotonic fit of the held-out fifth."""
    from pyspark.sql import functions as F

    from weftline.llm.labels import labelled_sample
    from weftline.llm.quality import BINS, FEATURES, _fourier, _held, fit_quality, statistics

    docs, labels = tables
    train = F.col("doc_id") % 3 == 1
    sample = labelled_sample(docs, labels, "quality", train, 10**6).withColumn("held", _held("pick")).toPandas()
    x, y, held = np.array([statistics(t or "") for t in sample.text]), sample.y.to_numpy(float), sample.held.to_numpy(bool)
    scale = x.std(0)
    z = _fourier((x - x.mean(0)) / np.where(scale > 1e-9, scale, 1.0))
    solve = lambda own: np.linalg.solve(z[own].T @ z[own] + 1e-3 * own.sum() * np.eye(FEATURES + 1) / FEATURES, z[own].T @ y[own])
    model = fit_quality(docs, labels, train, most=10**6)
    assert np.allclose(z @ model.weights, z @ solve(np.ones(len(y), bool)), atol=1e-6)
    raw = (z @ solve(~held))[held]
    bins = np.floor(np.clip(raw, -0.5, 1.5) * BINS).astype(int)
    names = np.unique(bins)
    n = np.array([(bins == b).sum() for b in names], float)
    level = np.array(plain_isotonic(np.array([y[held][bins == b].mean() for b in names]), n))
    centre = np.array([raw[bins == b].mean() for b in names])
    knots = [np.average(centre[level == v], weights=n[level == v]) for v in np.unique(level)]
    assert np.allclose(model.knots, knots, atol=1e-6) and np.allclose(model.values, np.unique(level))


def test_a_labelled_document_repeated_often(spark):
    """Ten thousand rows of one labelled id are one row of the sample."""
    from pyspark.sql import functions as F

    from weftline.llm.labels import labelled_sample, one_each

    docs = frame(spark, [(1, f"text {k % 7}") for k in range(10_000)] + [(2, "other")])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", F.lit(True), 100)
    assert rows.count() == 10_001 and one_each(rows, "text").count() == 2


def test_labels_of_other_documents_are_not_counted(spark):
    from pyspark.sql import functions as F

    from weftline.llm.labels import labelled_sample

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(0, 400, 10)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, "toxic", F.lit(True), 40).count() == 40
