import pytest
from pyspark.sql import functions as F

from weftline.operators import generators as gen
from weftline.operators import graph as g
from weftline.operators import isomorphism as iso
from weftline.operators import ordering as order
from weftline.operators import pagerank as pr
from weftline.operators import paths
from weftline.operators import point_to_point as p2p

TINY = [(1, 2, 4), (1, 3, 1), (3, 2, 2), (2, 4, 5), (3, 4, 8), (5, 1, 3)]
EDGE = "src long, dst long, w long"


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame(TINY, EDGE)


def rows(df, *columns):
    return {r[columns[0]]: (r[columns[1]] if len(columns) == 2 else tuple(r[c] for c in columns[1:])) for r in df.collect()}


@pytest.mark.parametrize("local", [0, 1000])
def test_sssp(tiny, local):
    assert rows(paths.sssp(tiny, 1, local_edges=local), "v", "d") == {1: 0, 2: 3, 3: 1, 4: 8, 5: None}
    assert rows(paths.sssp_to(tiny, 4, local_edges=local), "v", "d") == {4: 0, 2: 5, 3: 7, 1: 8, 5: 11}
    if not local:
        return
    assert rows(paths.bfs_hops(tiny, 1, local_edges=local), "v", "d") == {1: 0, 2: 1, 3: 1, 4: 2, 5: None}
    assert rows(paths.tree(tiny, 1, local_edges=local), "v", "pred") == {1: None, 2: 3, 3: 1, 4: 2}


@pytest.mark.parametrize("local", [0, 1000])
def test_unknown_source_and_isolated_vertex(spark, tiny, local):
    lone = spark.createDataFrame([(9,)], "v long")
    assert rows(paths.sssp(tiny, 1, within=lone, local_edges=local), "v", "d")[9] is None
    assert rows(paths.sssp(tiny, 77, local_edges=local), "v", "d")[77] == 0
    empty = spark.createDataFrame([], EDGE)
    assert rows(paths.sssp(empty, 1, local_edges=local), "v", "d") == {1: 0}


@pytest.mark.parametrize("local", [0, 1000])
def test_point_to_point(spark, tiny, local):
    q = spark.createDataFrame([(0, 1, 4), (1, 1, 1), (2, 4, 1), (3, 5, 4)], "qid long, src long, dst long")
    found = rows(p2p.paths(tiny, q, local_edges=local), "qid", "distance", "path")
    assert found == {0: (8, [1, 3, 2, 4]), 1: (0, [1]), 2: (None, []), 3: (11, [5, 1, 3, 2, 4])}
    assert rows(p2p.bidirectional(tiny, q, local_edges=local), "qid", "distance") == {0: 8, 1: 0, 2: None, 3: 11}
    marks = spark.createDataFrame([(1,), (3,)], "landmark long")
    bounds = p2p.upper_bound(q, p2p.landmark_in(tiny, marks, local_edges=local), p2p.landmark_out(tiny, marks, local_edges=local))
    assert rows(bounds, "qid", "bound", "landmark")[3] == (11, 1)
    if local:  # the queries over the tables run it distributed
        assert all(r.agree for r in p2p.strategies_agree(p2p.batch(tiny, q, 2, local_edges=local)).collect())


def test_random_graph_both_plans_and_properties(spark):
    edges = gen.undirected(spark, 60, 150, seed=3).persist()
    a = rows(paths.sssp(edges, 1), "v", "d")
    assert a == rows(paths.sssp(edges, 1, local_edges=10_000), "v", "d")
    assert len(a) == 60 and None not in a.values()
    assert all(a[r.dst] <= a[r.src] + r.w for r in edges.collect())
    assert rows(paths.sssp_to(edges, 1), "v", "d") == a  # undirected


def test_degrees(tiny):
    out, inn = rows(g.out_degree(tiny), "v", "degree"), rows(g.in_degree(tiny), "v", "degree")
    assert out == {1: 2, 2: 1, 3: 2, 4: 0, 5: 1} and inn == {1: 1, 2: 2, 3: 1, 4: 2, 5: 0}
    assert [r.v for r in g.top_degree(g.out_degree(tiny), 2).collect()] == [1, 3]
    assert rows(g.degree_groups(g.out_degree(tiny)), "degree", "vertices") == {0: [4], 1: [2, 5], 2: [1, 3]}


def test_normal_forms(spark):
    e = spark.createDataFrame([(1, 2, 5), (1, 2, 3), (2, 2, 1)], EDGE)
    assert sorted(map(tuple, g.dedup_edges(g.drop_self_loops(e)).collect())) == [(1, 2, 3)]
    assert sorted(map(tuple, g.symmetrize(g.drop_self_loops(e)).collect())) == [(1, 2, 3), (2, 1, 3)]
    assert sorted(map(tuple, g.closest(spark.createDataFrame([(4, 2), (3, 2)], "v long, d long")).collect())) == [(3, 2)]


def test_pagerank(spark):
    ring = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1)], EDGE)
    run = pr.pagerank(ring)
    assert rows(run.ranks, "v", "pr") == pytest.approx({1: 1.0, 2: 1.0, 3: 1.0}) and run.steps == 1
    run = pr.pagerank(spark.createDataFrame([(1, 2, 1)], EDGE))
    assert rows(run.ranks, "v", "pr") == pytest.approx({1: 0.15, 2: 0.2775}) and run.steps == 3


def test_pagerank_of_many_steps(spark):
    edges = gen.directed(spark, 40, 120, seed=2).persist()
    run = pr.pagerank(edges, eps=None, steps=19)
    links = [(r.src, r.dst) for r in edges.collect()]
    out = {v: sum(s == v for s, _ in links) for v in {x for e in links for x in e}}
    rank = dict.fromkeys(out, 1.0)
    for _ in range(19):
        rank = {v: 0.15 + 0.85 * sum(rank[s] / out[s] for s, d in links if d == v) for v in rank}
    assert rows(run.ranks, "v", "pr") == pytest.approx(rank) and run.steps == 19


def test_many_rounds_and_hubs(spark, monkeypatch):
    """A path of more rounds than are kept apart, and a hub whose edges lie in several shares."""
    from weftline.plans import fixpoint

    monkeypatch.setattr(fixpoint, "HUB", 4)
    edges = [(k, k + 1, 1) for k in range(1, 17)] + [(1, 100 + k, 5) for k in range(10)] + [(100 + k, 8, 1) for k in range(10)] + [(1, 17, 30)]
    got = rows(paths.sssp(spark.createDataFrame(edges, EDGE), 1), "v", "d")
    assert got == {**{k: min(k - 1, 6 + k - 8) if k >= 8 else k - 1 for k in range(1, 18)}, **{100 + k: 5 for k in range(10)}}


def synchronous(edges, src, dst):
    """(labels, last round) of the search from src that keeps no label above the best distance to dst so far."""
    d, last, front, k = {src: 0}, {src: 0}, {src}, 0
    while front:
        k += 1
        best = d.get(dst, float("inf"))
        new: dict = {}
        for s, t, w in edges:
            if s in front and d[s] + w <= best:
                new[t] = min(new.get(t, float("inf")), d[s] + w)
        front = {t for t, x in new.items() if x < d.get(t, float("inf"))}
        for t in front:
            d[t], last[t] = new[t], k
    return len(d), max(last.values())


@pytest.mark.parametrize("local", [0, 1000])
def test_counters_of_searches(spark, local):
    edges = gen.undirected(spark, 30, 60, seed=5).persist()
    q = [(k, k + 1, 29 - k) for k in range(6)] + [(6, 3, 3)]
    found = p2p.search_rounds(edges, spark.createDataFrame(q, "qid long, src long, dst long"), local_edges=local)
    known = [tuple(r) for r in edges.collect()]
    assert rows(found, "qid", "labels", "rounds") == {k: synchronous(known, s, t) for k, s, t in q}


def shortest(known, source):
    """Distances from a vertex, by Dijkstra's algorithm."""
    import heapq

    d, heap = {}, [(0, source)]
    while heap:
        x, v = heapq.heappop(heap)
        if v not in d:
            d[v] = x
            for s, t, w in known:
                if s == v:
                    heapq.heappush(heap, (x + w, t))
    return d


def test_searches_that_meet(spark, monkeypatch):
    """Distances, joining vertices and paths as of plain searches, with ties, hubs, bounds and ends that nothing joins."""
    from weftline.plans import fixpoint

    monkeypatch.setattr(fixpoint, "HUB", 8)
    known = [tuple(r) for r in gen.directed(spark, 40, 90, seed=1).withColumn("w", F.col("w") % 4 + 1).collect()]
    known += [(1, k, 3) for k in range(2, 30)] + [(k, k + 1, 1) for k in range(100, 104)] + [(5, 100, 2)]
    edges = spark.createDataFrame(known, EDGE).persist()
    pairs = [(k, 1 + k, 40 - 3 * k) for k in range(12)] + [(12, 7, 7), (13, 104, 1), (14, 1, 104), (15, 777, 777), (16, 1, 777), (17, None, None)]
    q = spark.createDataFrame(pairs, "qid long, src long, dst long").persist()
    distance, joining, walks = {}, {}, {}
    for k, s, t in pairs:
        there, back = shortest(known, s), shortest([(b, a, w) for a, b, w in known], t)
        distance[k] = None if s is None else there.get(t)
        on = [v for v in there if v in back and there[v] + back[v] == distance[k]]
        joining[k] = (distance[k], min(on) if on and s is not None else None)
        walk = [t] if distance[k] is not None else []
        while walk and walk[0] != s:
            walk = [min(a for a, b, w in known if b == walk[0] and a in there and there[a] + w == there[b]), *walk]
        walks[k] = (distance[k], walk)
    assert rows(p2p.bidirectional(edges, q), "qid", "distance", "joining_vertex") == joining
    assert rows(p2p.paths(edges, q), "qid", "distance", "path") == walks
    close = [(k, s, t, None if distance[k] is None else distance[k] + k % 3 - 1) for k, s, t in pairs]
    tight = spark.createDataFrame(close, "qid long, src long, dst long, bound long")
    short = {k: None if k % 3 == 0 else d for k, d in distance.items()}  # every third bound is less than the distance
    assert rows(p2p.distance(edges, q, both=False), "qid", "distance") == distance
    assert rows(p2p.distance(edges, tight), "qid", "distance") == short


def test_searches_that_meet_reach_little_of_the_graph(spark):
    from weftline.plans.fixpoint import Meeting

    edges = gen.directed(spark, 3000, seed=3).persist()
    q = spark.createDataFrame([(k, 10 + k, 2990 - k, None) for k in range(8)], "qid long, src long, dst long, bound long")
    assert Meeting(edges, q).labels.count() < 8 * 3000 / 4


def test_strategies_of_a_batch_share_their_rounds(spark, monkeypatch):
    edges = gen.directed(spark, 60, seed=4).persist()
    q = spark.createDataFrame([(k, 1 + k, 50 - 2 * k) for k in range(5)] + [(5, None, 3)], "qid long, src long, dst long")
    made = []
    monkeypatch.setattr(p2p, "Meeting", lambda *a, of=p2p.Meeting, **b: made.append(of(*a, **b)) or made[-1])
    found = p2p.batch(edges, q, 2).persist()
    assert len(made) == 2  # landmarks, and all strategies
    known = [tuple(r) for r in edges.collect()]
    right = {k: shortest(known, 1 + k).get(50 - 2 * k) for k in range(5)} | {5: None}
    assert {(r.qid, r.strategy): r.distance for r in found.collect()} == {(k, s): d for k, d in right.items() for s in p2p.STRATEGIES}
    assert all(r.agree for r in p2p.strategies_agree(found).collect())


def test_rounds_of_searches_share_writes(spark, monkeypatch):
    """A way of 40 steps, in graphs with and without hubs, takes fewer staged writes than half its steps, of which each end goes half."""
    from weftline.plans import fixpoint

    made = []
    monkeypatch.setattr(fixpoint.Stages, "write", lambda *a, of=fixpoint.Stages.write, **b: made.append(1) or of(*a, **b))
    known = [(k, k + 1, 1) for k in range(40)] + [(20, 100 + k, 1) for k in range(10)]
    edges = spark.createDataFrame(known, EDGE).persist()
    q = spark.createDataFrame([(0, 0, 40), (1, 40, 0), (2, 0, 109), (3, 7, 7)], "qid long, src long, dst long")
    for hub in (fixpoint.HUB, 4):
        monkeypatch.setattr(fixpoint, "HUB", hub)
        made.clear()
        assert rows(p2p.distance(edges, q), "qid", "distance") == {0: 40, 1: None, 2: 21, 3: 0}
        assert len(made) < 18


@pytest.mark.parametrize("long", [9_000, 40_000, 3 * 10**12])
def test_searches_of_long_edges(spark, long):
    edges = spark.createDataFrame([(1, 2, long), (2, 3, 5), (3, 4, long), (1, 4, 2 * long + 6), (4, 5, 1)], EDGE).persist()
    q = spark.createDataFrame([(0, 1, 5), (1, 2, 4), (2, 5, 1)], "qid long, src long, dst long")
    assert rows(p2p.bidirectional(edges, q), "qid", "distance", "joining_vertex") == {0: (2 * long + 6, 1), 1: (long + 5, 2), 2: (None, None)}


def test_searches_keep_a_row_for_each_vertex(spark):
    from weftline.plans.fixpoint import Meeting

    edges = gen.directed(spark, 50, seed=2).persist()
    q = spark.createDataFrame([(k, k, k, None) for k in (3, 8, 30)], "qid long, src long, dst long, bound long")
    run = Meeting(edges, q, meet=False)
    assert run.table.count() <= 50 < run.labels.count()
    known = [tuple(r) for r in edges.collect()]
    there = {(r.q, r.v): r.f for r in run.everywhere().where("f is not null").collect()}
    assert there == {(k, v): d for k in (3, 8, 30) for v, d in shortest(known, k).items()}


def test_searches_of_a_graph_that_a_task_holds_need_no_rounds(spark, monkeypatch):
    """A batch on ways of 80 steps takes as many staged writes as one on short ways."""
    from weftline.plans import fixpoint

    made = []
    monkeypatch.setattr(fixpoint.Stages, "write", lambda *a, of=fixpoint.Stages.write, **b: made.append(1) or of(*a, **b))
    known = [(k, k + 1, 1 + k % 3) for k in range(80)] + [(80, 0, 500), (3, 200, 2), (200, 4, 1)]
    q = spark.createDataFrame([(0, 0, 80), (1, 80, 79), (2, 200, 3), (3, 9, 999)], "qid long, src long, dst long")
    found = {(r.qid, r.strategy): r.distance for r in p2p.batch(spark.createDataFrame(known, EDGE), q, 2).collect()}
    right = {k: shortest(known, s).get(t) for k, s, t in [(0, 0, 80), (1, 80, 79), (2, 200, 3), (3, 9, 999)]}
    assert found == {(k, s): d for k, d in right.items() for s in p2p.STRATEGIES}
    assert len(made) <= 8


@pytest.mark.parametrize("of", ["meet", "writes", "rows", "long"])
def test_searches_of_larger_graphs_go_in_rounds(spark, monkeypatch, of):
    """The tests of searches, in graphs that no task holds whole."""
    from weftline.plans import fixpoint

    monkeypatch.setattr(fixpoint, "WHOLE", -1)
    if of == "meet":
        test_searches_that_meet(spark, monkeypatch)
    elif of == "writes":
        test_rounds_of_searches_share_writes(spark, monkeypatch)
    elif of == "rows":
        test_searches_keep_a_row_for_each_vertex(spark)
    else:
        test_searches_of_long_edges(spark, 40_000)


def test_strategies_and_their_times(spark, tiny):
    q = spark.createDataFrame([(0, 1, 4), (1, 4, 1)], "qid long, src long, dst long")
    for name in p2p.STRATEGIES:
        assert rows(p2p.solve(tiny, q, name, local_edges=1000), "qid", "distance") == {0: 8, 1: None}
    with pytest.raises(ValueError):
        p2p.solve(tiny, q, "guess")
    timed = p2p.batch(tiny, q, 2, timed=True, local_edges=1000).collect()
    assert len(timed) == 8 and all(r.micros > 0 for r in timed)


def test_limited(spark):
    found = spark.createDataFrame([(k, None if k % 3 else k) for k in range(20)], "qid long, distance long")
    assert sorted(r.qid for r in p2p.limited(found, 3, 30).collect()) == list(range(7))
    assert sorted(r.qid for r in p2p.limited(found, 30, 4).collect()) == list(range(6))
    assert p2p.limited(found, 30, 30).count() == 20


def test_walks(spark):
    from weftline.queries import _seeds, literal_pairs

    edges = literal_pairs(spark)
    walks = iso.paired_walk(edges, _seeds(edges)).collect()
    assert rows(iso.any_walk(edges, _seeds(edges)), "pair", "walk") == {p: any(w.walk for w in walks if w.pair == p) for p in ("six", "eight", "three")}


def test_isomorphism(spark):
    from weftline.queries import _all_pairs

    assert rows(iso.is_isomorphic(_all_pairs(spark)), "pair", "isomorphic") == {
        "six": False, "eight": True, "three": True, "complete": False, "skew": False,
    }


def test_isomorphism_survives_relabelling():
    import random

    rng = random.Random(4)
    for n in (5, 9, 14):
        one = {v: set() for v in range(n)}
        for a in range(n):
            for b in range(a):
                if rng.random() < 0.4:
                    one[a].add(b)
                    one[b].add(a)
        names = rng.sample(range(100), n)
        two = {names[v]: {names[u] for u in us} for v, us in one.items()}
        assert iso.isomorphic(one, two)
        a, b = next((a, b) for a in one for b in one if a < b and b not in one[a])
        two[names[a]].add(names[b])
        two[names[b]].add(names[a])
        assert not iso.isomorphic(one, two)


def test_order(spark):
    values = spark.createDataFrame(list(enumerate([5, 1, 5, 3])), "pos long, value int")
    got = [tuple(r) for r in order.rank(values, F.col("value"), F.col("pos")).orderBy("rank").select("rank", "value", "pos").collect()]
    assert got == [(1, 1, 1), (2, 3, 3), (3, 5, 0), (4, 5, 2)]
    nxt = rows(order.lead(values, "pos", F.col("value"), F.col("pos")), "pos", "next")
    assert nxt == {1: 3, 3: 0, 0: 2, 2: None}
    assert order.rank(values.where("false"), F.col("pos")).count() == 0
    merged = order.merge_runs(values.where("pos < 2"), values.where("pos >= 2"), "value", "pos").collect()
    assert [(r.run, r.value) for r in merged] == [(0, 1), (1, 3), (0, 5), (1, 5)]
    assert [r.value for r in order.top_k(values, 2, F.desc("value"), "pos").collect()] == [5, 5]


def test_generators(spark):
    assert gen.check_size(20) == 99
    for bad in ((10, None), (20, 18), (20, 191), (10_000_001, None)):
        with pytest.raises(ValueError):
            gen.check_size(*bad)
    e = gen.undirected(spark, 20, 190).collect()  # complete
    assert len({(r.src, r.dst) for r in e}) == len(e) == 380 and all(1 <= r.w <= 20 for r in e)
    d = gen.directed(spark, 30).collect()
    assert len({(r.src, r.dst) for r in d}) == 149 and all(r.src != r.dst for r in d)
    assert gen.array(spark, 50).where("value between 1 and 100").count() == 50
