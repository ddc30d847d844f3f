import numpy as np
import pytest

KIND = "vec_id long, embedding array<float>, label int, cell int, key string, n long"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((240, 16)).astype(np.float32)
    x[40:70] = x[10] + 0.05 * rng.standard_normal((30, 16)).astype(np.float32)
    x[70:75] = x[11]  # equal vectors
    out = [(i, [float(v) for v in x[i]], i % 2 if i < 40 or i >= 75 else 0) for i in range(240)]
    out += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [float("nan")] + [1.0] * 15, 0), (304, [None] + [1.0] * 15, 0)]
    out += [(305, [1.0] * 15, 0), (306, out[11][1], None), (307, [float("inf")] + [1.0] * 15, 0), (308, [2 * v for v in out[12][1]], out[12][2])]
    out += [(310 + k, [3.0, 4.0], 0) for k in range(2)] + [(312, [3.0, 4.1], 0), (313, [float(v) for v in range(20)], 0), (320, [1.0, -2.0], 0), (321, [1.0] * 20, 0)]
    return [*out, out[5], (None, out[5][1], out[5][2])]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], KIND).repartition(3)


def brute(rows, threshold=0.98):
    ok = [(k, np.array(x, float)) for k, (i, x, label) in enumerate(rows) if i is not None and label is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    group, links = {r[0]: {r[0]} for r in rows}, dict.fromkeys(range(len(rows)), 0)
    for a, x in ok:
        for b, y in ok:
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                p, q = group[rows[a][0]], group[rows[b][0]]
                if p is not q:
                    p |= q
                    for i in q:
                        group[i] = p
    return sorted(((r[0], links[k], min(group[r[0]]) if r[0] is not None else None) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("block, centres", [(256, 512), (8, 8)])
def test_near_duplicate_vectors(spark, rows, monkeypatch, block, centres):
    from weftline.llm import embedding_dedup as module

    for name, value in (("BLOCK", block), ("LIST", block), ("CENTRES", centres)):
        monkeypatch.setattr(module, name, value)
    got = module.near_duplicate_vectors(table(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert module.near_duplicate_vectors(table(spark, rows).where("false")).count() == 0


def near_counts(rows, threshold=0.98):
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    return (unit @ unit.T >= threshold).sum(1) - 1


@pytest.mark.parametrize("block", [256, 16])
def test_links_along_few_directions(spark, monkeypatch, block):
    """Near copies whose differences lie in few directions cross more cells than ones that differ in all."""
    from weftline.llm import embedding_dedup as module

    monkeypatch.setattr(module, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 2)) @ rng.standard_normal((2, 32))
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], 0) for i in range(len(x))]
    got = {r.vec_id: r.n_links for r in module.near_duplicate_vectors(table(spark, rows)).collect()}
    assert got == dict(enumerate(near_counts(rows).tolist()))


def test_links_of_a_larger_table(spark):
    """Planted near copies among 6,000 vectors, by brute force: none is missed; a lower target misses few."""
    from weftline.llm import embedding_dedup as module

    rng = np.random.default_rng(9)
    x = rng.standard_normal((6000, 32))
    x[3000:] = x[rng.integers(0, 3000, 3000)] + 0.08 * rng.standard_normal((3000, 32))
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], 0) for i in range(len(x))]
    want = near_counts(rows)
    assert want.sum() > 5000
    got = {r.vec_id: r.n_links for r in module.near_duplicate_vectors(table(spark, rows)).collect()}
    assert got == dict(enumerate(want.tolist()))
    some = sum(r.n_links for r in module.near_duplicate_vectors(table(spark, rows), recall=0.95).collect())
    assert 0.9 * want.sum() <= some <= want.sum()


def test_visits_come_nearest_first():
    from weftline.llm.embedding_dedup import MultiIndex

    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 6))
    index = MultiIndex(rng.standard_normal((5, 3)), rng.standard_normal((4, 3)))
    first, second = index.planes(x)
    rows, cells = index.visits(x, 1.5, 4)
    for row in range(len(x)):
        sums = (first[row][:, None] + second[row]).ravel()
        own = cells[rows == row]
        assert (np.diff(sums[own]) >= 0).all() and set(own) == set(np.flatnonzero(sums <= 1.5**2))


def test_a_vector_repeated_often(spark):
    from weftline.llm.embedding_dedup import near_duplicate_vectors
    from weftline.llm.topk_search import top_k

    rows = [(20, [1.0, 2.0], 0)] * 10_000 + [(21, [1.0, 2.0], 0)]
    got = near_duplicate_vectors(table(spark, rows)).groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(10_000, 20, 10_001)]
    assert [(r.query_id, r.vec_id) for r in top_k(table(spark, rows)).collect()] == [(20, 21)]


def exact_products(rows, k=20):
    usable = [(i, [int(np.floor(64 * v)) if abs(v) < 1e300 else int(v) * 64 for v in x]) for i, x, _ in rows if i is not None and x and None not in x and np.isfinite(x).all()]
    want = []
    for q, v in {i: x for i, x in usable if i % 20 == 0}.items():
        scores = [(i, sum(a * b for a, b in zip(v, x, strict=True))) for i, x in usable if i != q and len(x) == len(v)]
        best = sorted((-min(max(s, -(2**63) + 1), 2**63 - 1), i) for i, s in scores)[:k]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(want)


@pytest.mark.parametrize("block", [8192, 8])
def test_top_k(spark, rows, monkeypatch, block):
    from weftline.llm import topk_search as module

    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "QUERIES", block)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in module.top_k(table(spark, rows)).collect()]
    assert sorted(got) == exact_products(rows)
    assert module.top_k(table(spark, rows).where("false")).count() == 0
    few = module.top_k(table(spark, rows).where("vec_id in (0, 1, 2)")).collect()
    assert [(r.query_id, r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2)]


def test_top_k_of_huge_components(spark):
    from weftline.llm.topk_search import top_k

    big = [[1e308, 1.0], [-1e308, 2.0], [1e12, 3.5], [3e9, -1e300], [0.5, 0.25], [5e-324, 1e-3], [2.0**31, 1.0]]
    rows = [(20 * k, x, 0) for k, x in enumerate(big)] + [(1 + k, x, 0) for k, x in enumerate(big)]
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(docs, k=5).collect()]
    assert sorted(got) == exact_products(rows, 5)


def test_bounds_exclude_where_vectors_cluster(spark):
    from weftline.llm.topk_search import top_k, visited_share

    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 8))
    centres *= 10 / np.linalg.norm(centres, axis=1)[:, None]
    x = (centres[rng.integers(0, 40, 4000)] + 0.1 * rng.standard_normal((4000, 8))).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    docs = table(spark, rows).repartition(4)
    assert visited_share(docs, k=5) < 0.5
    v = np.floor(64 * x.astype(np.float64))
    scores = v[::20] @ v.T
    scores[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    got = {(r.query_id, r["rank"]): r.score for r in top_k(docs, k=5).collect()}
    assert all(got[20 * q, 1] == scores[q].max() for q in range(200))


def test_components(spark):
    import random

    from weftline.llm.common import components
    from weftline.plans.stages import Stages

    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(50)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(500, k) for k in range(501, 560)]
    group = {}
    for a, b in edges:
        p, q = group.setdefault(a, {a}), group.setdefault(b, {b})
        if p is not q:
            p |= q
            for i in q:
                group[i] = p
    got = {r.node: r.component for r in components(Stages(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v: got.get(v, v) for v in group} == {v: min(s) for v, s in group.items()}
