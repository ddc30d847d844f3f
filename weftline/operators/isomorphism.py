"""Graph isomorphism: many pairs at once, each decided exactly."""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vertices that one graph of a pair may have (fixed value), which bounds a task.
MOST = 999


def seed_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(g1v, g2v): all vertices of one graph with all of the other; both have at most MOST, which is checked."""
    for rows in (first, second):
        n = rows.limit(MOST + 1).count()
        if n > MOST:
            raise ValueError(f"a graph of a pair may have {MOST} vertices")
    return first.select(F.col("v").alias("g1v")).crossJoin(second.select(F.col("v").alias("g2v")))


def invariants(edges: DataFrame) -> DataFrame:
    """(pair, g, n, m, degrees): what isomorphic graphs share. Edges are (pair, g, src, dst), each both ways."""
    degree = edges.groupBy("pair", "g", "src").agg(F.count("*").alias("d"))
    return degree.groupBy("pair", "g").agg(
        F.count("*").alias("n"), F.sum("d").alias("m"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list("d")), lambda x: x.cast("string"))).alias("degrees")
    )


def is_isomorphic(edges: DataFrame) -> DataFrame:
    """(pair, isomorphic) for graphs g = 1 and g = 2 of each pair, given as (pair, g, src, dst) with each edge both ways.

    Pairs that differ in vertices, edges or degrees are decided by aggregation.
    The others are searched one a task: colours are refined, and partial mappings
    grow along vertices of equal colour, each step checked for edges and
    non-edges. Vertices without edges are not part of a graph here.
    """
    facts = invariants(edges)
    a, b = (facts.where(F.col("g") == g).select("pair", F.struct("n", "m", "degrees").alias(f"f{g}")) for g in (1, 2))
    same = a.join(b, "pair", "full_outer").select("pair", F.col("f1").eqNullSafe(F.col("f2")).alias("same"))
    open_ = edges.join(same.where("same").select("pair"), "pair", "left_semi")
    found = open_.groupBy("pair").applyInPandas(_decide, "pair string, isomorphic boolean")
    return same.where("not same").select("pair", F.lit(False).alias("isomorphic")).unionByName(found)


def _graph(rows: pd.DataFrame) -> dict[int, set[int]]:
    out: dict[int, set[int]] = defaultdict(set)
    for s, d in zip(rows.src, rows.dst, strict=True):
        out[s].add(d)
        out[d].add(s)
    if len(out) > MOST:
        raise ValueError(f"a graph of a pair may have {MOST} vertices, not {len(out)}")
    return dict(out)


def _refined(graphs: list[dict[int, set[int]]]) -> list[dict[int, int]]:
    """Colours that both graphs share: equal if neighbourhoods of any depth look alike."""
    colours = [dict.fromkeys(g, 0) for g in graphs]
    n = 1
    while True:
        keys = [{v: (c[v], tuple(sorted(c[u] for u in g[v]))) for v in g} for g, c in zip(graphs, colours, strict=True)]
        names = {k: i for i, k in enumerate(sorted(set(keys[0].values()) | set(keys[1].values())))}
        colours = [{v: names[k] for v, k in own.items()} for own in keys]
        if len(names) == n:
            return colours
        n = len(names)


def isomorphic(first: dict[int, set[int]], second: dict[int, set[int]]) -> bool:
    """Exact decision for two undirected graphs as neighbour sets."""
    if _shape(first) != _shape(second):
        return False
    c1, c2 = _refined([first, second])
    if Counter(c1.values()) != Counter(c2.values()):
        return False
    of_colour = defaultdict(set)
    for v, c in c2.items():
        of_colour[c].add(v)
    size = {c: len(vs) for c, vs in of_colour.items()}
    order, seen = [], set()
    while len(order) < len(first):  # rarest colours first, then along edges, so that each step is constrained
        reach = [v for u in order for v in first[u] if v not in seen] or [v for v in first if v not in seen]
        v = min(reach, key=lambda x: (size[c1[x]], -sum(u in seen for u in first[x]), x))
        order.append(v)
        seen.add(v)
    fits, taken = {}, set()
    choices = [iter(sorted(of_colour[c1[order[0]]]))] if order else []
    while len(fits) < len(order):
        v = order[len(choices) - 1]
        for w in choices[-1]:
            near = {fits[u] for u in first[v] if u in fits}
            if w not in taken and near == second[w] & taken:
                fits[v] = w
                taken.add(w)
                if len(choices) < len(order):
                    choices.append(iter(sorted(of_colour[c1[order[len(choices)]]])))
                break
        else:
            choices.pop()
            if not choices:
                return False
            taken.discard(fits.pop(order[len(choices) - 1]))
    return True


def _shape(graph: dict[int, set[int]]) -> Counter:
    """How often each (vertices, edges) occurs among the connected components: decides most regular graphs."""
    seen, out = set(), Counter()
    for start in graph:
        if start in seen:
            continue
        stack, members = [start], {start}
        while stack:
            for u in graph[stack.pop()]:
                if u not in members:
                    members.add(u)
                    stack.append(u)
        seen |= members
        out[(len(members), sum(len(graph[v]) for v in members))] += 1
    return out


def _decide(rows: pd.DataFrame) -> pd.DataFrame:
    graphs = [_graph(rows[rows.g == g]) for g in (1, 2)]
    return pd.DataFrame({"pair": [rows.pair.iloc[0]], "isomorphic": [isomorphic(*graphs)]})


def paired_walk(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(pair, g1v, g2v, walk): whether simple paths through all vertices exist side by side from each seed pair.

    A necessary condition only, and exponential in the worst case: a heuristic
    for graphs of a few vertices. Edges are (pair, g, src, dst), seeds (pair, g1v, g2v).
    """
    return _seeded(edges, seeds).mapInPandas(_walks, "pair string, g1v long, g2v long, walk boolean")


def any_walk(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(pair, walk): whether any seed of a pair has such paths; the seeds after the first that has are not searched."""
    lists = edges.groupBy("pair").agg(F.collect_list(F.struct("g", "src", "dst")).alias("edges"))
    rows = seeds.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("g1v", "g2v"))).alias("seeds")).join(lists, "pair")
    return rows.mapInPandas(_first_walk, "pair string, walk boolean")


def _seeded(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    lists = edges.groupBy("pair").agg(F.collect_list(F.struct("g", "src", "dst")).alias("edges"))
    return seeds.join(lists, "pair")


def _walk(edges, first: int, second: int) -> bool:
    graphs = [defaultdict(set), defaultdict(set)]
    for e in edges:
        graphs[e["g"] - 1][e["src"]].add(e["dst"])
    n = len(graphs[0])
    stack = [((first,), (second,))]
    while stack and n == len(graphs[1]):
        a, b = stack.pop()
        if len(a) == n:
            return True
        stack += [(a + (u,), b + (v,)) for u in graphs[0][a[-1]] if u not in a for v in graphs[1][b[-1]] if v not in b]
    return False


def _walks(frames):
    for frame in frames:
        walk = [_walk(row.edges, row.g1v, row.g2v) for row in frame.itertuples()]
        yield frame[["pair", "g1v", "g2v"]].assign(walk=walk)


def _first_walk(frames):
    for frame in frames:
        walk = [any(_walk(row.edges, s["g1v"], s["g2v"]) for s in row.seeds) for row in frame.itertuples()]
        yield frame[["pair"]].assign(walk=walk)
