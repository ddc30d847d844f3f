"""Point-to-point shortest paths: bounds by landmarks, search from one or both ends, paths, workloads.

Queries are rows (qid, src, dst). Distances are null where there is no path, 0
from a vertex to itself.
"""

from __future__ import annotations

from time import perf_counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.hashing import pseudo
from weftline.operators.graph import in_degree, out_degree, top_degree
from weftline.operators.ordering import rank
from weftline.plans.fixpoint import Meeting, Parts, search
from weftline.plans.stages import Stages

#: Degree pools of the stratified workloads, (out pool, in pool, first from which) by choice (fixed values).
CHOICES = {
    1: ("in high", "out high"), 2: ("out high", "in high"), 3: ("in low", "out low"), 4: ("out low", "in low"),
    5: ("out low", "in high"), 6: ("out high", "in low"), 7: ("out median", "in median"), 8: ("out median", "in high"),
    9: ("out median", "in low"), 10: ("out high", "in median"), 11: ("out low", "in median"),
}


def landmarks(edges: DataFrame, k: int) -> DataFrame:
    """(landmark): the k vertices of greatest out-degree, ties by id."""
    return top_degree(out_degree(edges), k).select(F.col("v").alias("landmark"))


def _landmark_labels(edges: DataFrame, marks: DataFrame, direction: int, local_edges) -> DataFrame:
    null = F.lit(None).cast("long")
    seeds = marks.select(
        F.col("landmark").alias("q"), F.lit(direction).alias("dir"), F.col("landmark").alias("v"),
        F.lit(0).cast("long").alias("d"), null.alias("bound"), null.alias("target"),
    )
    return search(edges, seeds, local_edges=local_edges).select(F.col("q").alias("landmark"), "v", F.col("d").alias("dist"))


def landmark_out(edges: DataFrame, marks: DataFrame, *, local_edges=0) -> DataFrame:
    """(landmark, v, dist): distances from each landmark, all in one search."""
    return _landmark_labels(edges, marks, 0, local_edges)


def landmark_in(edges: DataFrame, marks: DataFrame, *, local_edges=0) -> DataFrame:
    """(landmark, v, dist): distances to each landmark."""
    return _landmark_labels(edges, marks, 1, local_edges)


def upper_bound(queries: DataFrame, lm_in: DataFrame, lm_out: DataFrame) -> DataFrame:
    """(qid, src, dst, bound, landmark): the least way through a landmark, ties to the smaller one."""
    a = queries.join(lm_in.select("landmark", F.col("v").alias("src"), F.col("dist").alias("a")), "src")
    b = a.join(lm_out.select("landmark", F.col("v").alias("dst"), F.col("dist").alias("b")), ["landmark", "dst"])
    best = b.groupBy("qid").agg(F.min(F.struct((F.col("a") + F.col("b")).alias("bound"), "landmark")).alias("m"))
    return queries.join(best, "qid", "left").select("qid", "src", "dst", "m.bound", "m.landmark")


def _bounded(queries: DataFrame) -> DataFrame:
    return queries if "bound" in queries.columns else queries.withColumn("bound", F.lit(None).cast("long"))


def _forward(queries: DataFrame) -> DataFrame:
    return _bounded(queries).select(
        F.col("qid").alias("q"), F.lit(0).alias("dir"), F.col("src").alias("v"), F.lit(0).cast("long").alias("d"),
        "bound", F.col("dst").alias("target"),
    )


def distance(edges: DataFrame, queries: DataFrame, *, both=True, local_edges=0) -> DataFrame:
    """(qid, src, dst, distance) by searches from both ends that stop where they meet, or from the source alone; a column ``bound`` of the queries prunes them."""
    if local_edges and both:
        return bidirectional(edges, queries, local_edges=local_edges).select("qid", "src", "dst", "distance")
    if local_edges:
        found = search(edges, _forward(queries), local_edges=local_edges).select(F.col("q").alias("qid"), F.col("v").alias("dst"), F.col("d").alias("distance"))
        return queries.select("qid", "src", "dst").join(found, ["qid", "dst"], "left").select("qid", "src", "dst", "distance")
    found = Meeting(edges, _bounded(queries), both=both, kept=False).distances()
    return queries.select("qid", "src", "dst").join(found, "qid", "left")


def _on_paths(edges: DataFrame, queries: DataFrame, local_edges) -> DataFrame:
    """(q, v, d): every vertex of every shortest path, and its distance from the source."""
    if not local_edges:
        return Meeting(edges, _bounded(queries)).on_paths()
    null = F.lit(None).cast("long").alias("target")
    there, back = (
        _bounded(queries).select(F.col("qid").alias("q"), F.lit(side).alias("dir"), F.col(end).alias("v"), F.lit(0).cast("long").alias("d"), "bound", null)
        for side, end in enumerate(("src", "dst"))
    )
    # every vertex of a shortest path keeps both labels
    labels = search(edges, there.unionByName(back), meet=True, local_edges=local_edges)
    both = labels.groupBy("q", "v").agg(F.sum("d").alias("sum"), F.min(F.when(F.col("dir") == 0, F.col("d"))).alias("d"), F.count("*").alias("n")).where("n = 2")
    both = Stages(edges.sparkSession).write(both)
    return both.join(both.groupBy("q").agg(F.min("sum").alias("sum")), ["q", "sum"]).select("q", "v", "d")


def bidirectional(edges: DataFrame, queries: DataFrame, *, local_edges=0) -> DataFrame:
    """(qid, src, dst, distance, joining_vertex) by search from both ends; the joining vertex is the smallest of all shortest paths."""
    on = _on_paths(edges, queries, local_edges)
    ends = queries.select("qid", "src", "dst")
    best = on.groupBy(F.col("q").alias("qid")).agg(F.max("d").alias("distance"), F.min("v").alias("joining_vertex"))
    return ends.join(best, "qid", "left")


def bounds_of(edges: DataFrame, queries: DataFrame, k: int = 4, *, parts: Parts | None = None, local_edges=0) -> DataFrame:
    """``upper_bound`` by k landmarks, staged; distances from and to all of them are one search, in ``parts`` if the edges were dealt out."""
    marks = landmarks(edges, k)
    if local_edges:
        lm_in, lm_out = landmark_in(edges, marks, local_edges=local_edges), landmark_out(edges, marks, local_edges=local_edges)
    else:
        at = F.col("landmark")
        ends = marks.select(at.alias("qid"), at.alias("src"), at.alias("dst"), F.lit(None).cast("long").alias("bound"))
        labels = Meeting(parts or edges, ends, meet=False).everywhere()
        lm_in, lm_out = (labels.where(f"{side} is not null").select(F.col("q").alias("landmark"), "v", F.col(side).alias("dist")) for side in ("b", "f"))
    return Stages(edges.sparkSession).write(upper_bound(queries, lm_in, lm_out))


def with_bounds(edges: DataFrame, queries: DataFrame, k: int = 4, *, both=True, bounds: DataFrame | None = None, local_edges=0) -> DataFrame:
    """(qid, src, dst, distance, bound): landmark bounds first, unless they are given, then the search that they prune."""
    bounds = bounds_of(edges, queries, k, local_edges=local_edges) if bounds is None else bounds
    found = distance(edges, bounds, both=both, local_edges=local_edges)
    return found.join(bounds.select("qid", "bound"), "qid").select("qid", "src", "dst", "distance", "bound")


def paths(edges: DataFrame, queries: DataFrame, *, local_edges=0) -> DataFrame:
    """(qid, src, dst, distance, path array<long>): of the shortest paths the one that, seen from the
    destination, always comes from the smallest predecessor. [src] if src = dst, empty if there is none.

    Searches from both ends find the vertices of all shortest paths. Jumps of
    1, 2, 4 ... steps back are made by doubling over the predecessors of these;
    from the longest to the shortest, each doubles the known places of the paths.
    So the rounds that gather paths grow with the logarithm of the longest.
    """
    stages = Stages(edges.sparkSession)
    labels = _on_paths(edges, queries, local_edges)
    ends = queries.select(F.col("qid").alias("q"), "src", F.col("dst").alias("v")).join(labels, ["q", "v"])
    tight = (
        labels.select("q", F.col("v").alias("src"), F.col("d").alias("d_src"))
        .join(edges, "src")
        .join(labels.select("q", F.col("v").alias("dst"), F.col("d").alias("d_dst")), ["q", "dst"])
        .where("d_src + w = d_dst")
    )
    # jump: (q, v, to, n): n steps back from v stands ``to``; the source stays where it is
    roots = labels.where("d = 0").select("q", "v", F.col("v").alias("to"), F.lit(0).cast("long").alias("n"))
    preds = tight.groupBy("q", F.col("dst").alias("v")).agg(F.min("src").alias("to")).withColumn("n", F.lit(1).cast("long"))
    levels = [stages.write(preds.unionByName(roots.join(preds, ["q", "v"], "left_anti")))]
    places = stages.write(ends.select("q", "v", F.lit(0).cast("long").alias("back")))  # of destinations, counted from the end
    while True:
        far = levels[-1]
        if places.join(far.where("n = {}".format(1 << (len(levels) - 1))), ["q", "v"], "left_semi").isEmpty():
            break
        on = far.select("q", F.col("v").alias("to"), F.col("to").alias("further"), F.col("n").alias("more"))
        levels.append(stages.write(far.join(on, ["q", "to"]).select("q", "v", F.col("further").alias("to"), (F.col("n") + F.col("more")).alias("n"))))
    for far in reversed(levels):  # from the longest jumps to the shortest, each doubles the places that are known
        more = places.join(far.where("n > 0"), ["q", "v"]).select("q", F.col("to").alias("v"), (F.col("back") + F.col("n")).alias("back"))
        after = stages.write(places.unionByName(more).distinct())
        stages.drop(places)
        places = after
    walks = places.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "v"))), lambda x: x["v"]).alias("path"))
    found = ends.select("q", F.col("d").alias("distance")).join(walks, "q").withColumnRenamed("q", "qid")
    out = queries.select("qid", "src", "dst").join(found, "qid", "left")
    return out.withColumn("path", F.coalesce("path", F.array().cast("array<long>")))


def _pool(ranked: DataFrame, n: int, low_from: int, name: str) -> DataFrame:
    """(place, v) of a pool of a degree order (v, degree, rank from 0): low, high or median."""
    r = F.col("rank")
    if name == "low":
        rows = ranked.where((r >= low_from) & (r < low_from + max(1, n // 20))).withColumn("place", r - low_from)
    elif name == "high":
        rows = ranked.where(r >= n - max(1, n // 25)).withColumn("place", F.lit(n - 1) - r)
    else:
        start = n // 2 - n // 40
        rows = ranked.where((r >= start) & (r < start + max(1, n // 15))).withColumn("place", r - start)
    return rows.select(F.col("place").cast("long").alias("place"), "v")


def degree_rank(degrees: DataFrame) -> DataFrame:
    """(v, degree, rank from 0) in ascending order of (degree, v)."""
    return rank(degrees, F.col("degree"), F.col("v"), start=0).select("v", "degree", "rank")


def pairs_by_degree(edges: DataFrame, choice: int, n: int = 100, seed: int = 0) -> DataFrame:
    """(qid, src, dst): n pairs from the degree pools of one of CHOICES.

    low: the first twentieth above degree 0, high: the last 25th, median: a
    fifteenth around the middle of the order by (degree, id).
    """
    spark = edges.sparkSession
    sides = []
    for spec in CHOICES[choice]:
        kind, name = spec.split()
        degrees = Stages(spark).write(degree_rank(out_degree(edges) if kind == "out" else in_degree(edges)))
        total, zero = degrees.agg(F.count("*"), F.count_if(F.col("degree") == 0)).first()
        pool = _pool(degrees, total, zero, name)
        sides.append((pool, pool.count()))
    (a, na), (b, nb) = sides
    if not na or not nb:
        return spark.createDataFrame([], "qid long, src long, dst long")
    picks = spark.range(n).select(F.col("id").alias("qid"), (pseudo("id", seed) % na).alias("i"), (pseudo("id", seed + 1) % nb).alias("j"))
    picks = picks.join(a.toDF("i", "src"), "i").join(b.toDF("j", "dst"), "j")
    return picks.select("qid", "src", "dst")


def file_and_random(pairs: DataFrame, random: DataFrame) -> DataFrame:
    """Choice 12: pairs from a file before random ones, numbered anew."""
    n = pairs.count()
    return pairs.unionByName(random.withColumn("qid", F.col("qid") + n)).select("qid", "src", "dst")


#: Ways to answer a query: (from both ends, with landmark bounds).
STRATEGIES = {"one end": (False, False), "both ends": (True, False), "one end, bounds": (False, True), "both ends, bounds": (True, True)}


def solve(edges: DataFrame, queries: DataFrame, strategy: str = "both ends", k: int = 4, *, bounds: DataFrame | None = None, local_edges=0) -> DataFrame:
    """(qid, src, dst, distance) by one of STRATEGIES; ``bounds`` may hold what ``bounds_of`` found."""
    if strategy not in STRATEGIES:
        raise ValueError(f"a strategy is one of {', '.join(STRATEGIES)}, not {strategy}")
    both, bounded = STRATEGIES[strategy]
    if bounded:
        found = with_bounds(edges, queries, k, both=both, bounds=bounds, local_edges=local_edges)
    else:
        found = distance(edges, queries, both=both, local_edges=local_edges)
    return found.select("qid", "src", "dst", "distance")


def _together(edges: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, src, dst, strategy, distance) by one search of all queries, once for each strategy; the edges are dealt out once."""
    ends = queries.select(F.explode(F.array(F.col("src").cast("long"), F.col("dst").cast("long"))).alias("v")).where("v is not null").distinct()
    parts, asks = Parts(edges, ends, len(STRATEGIES) * queries.count()), None
    bounds = bounds_of(parts.edges, queries, k, parts=parts)
    for name, (both, bounded) in STRATEGIES.items():
        bound = F.col("bound") if bounded else F.lit(None).cast("long").alias("bound")
        part = bounds.select("qid", "src", "dst", F.lit(name).alias("strategy"), F.lit(both).alias("both"), bound)
        asks = part if asks is None else asks.unionByName(part)
    found = Meeting(parts, asks, both="both", kept=False, keys=("qid", "strategy")).distances()
    parts.close()
    return asks.select("qid", "src", "dst", "strategy").join(found, ["qid", "strategy"], "left").select("qid", "src", "dst", "strategy", "distance")


def batch(edges: DataFrame, queries: DataFrame, k: int = 4, *, timed=False, local_edges=0) -> DataFrame:
    """(qid, src, dst, strategy, distance): every query by every strategy.

    Bounds are found once for the strategies that use them. The searches of all
    strategies are searches of their own that share rounds. ``timed`` adds
    micros, what a query took on average without its bound: all queries of a
    strategy advance together, so they are timed together, one strategy after
    another.
    """
    if not timed and not local_edges:
        return _together(edges, queries, k)
    bounds = bounds_of(edges, queries, k, local_edges=local_edges)
    n, out = queries.count() if timed else 0, None
    for name in STRATEGIES:
        began = perf_counter()
        part = solve(edges, queries, name, k, bounds=bounds, local_edges=local_edges).select("qid", "src", "dst", F.lit(name).alias("strategy"), "distance")
        if timed:
            part = Stages(edges.sparkSession).write(part)
            part = part.withColumn("micros", F.lit((perf_counter() - began) * 1e6 / max(n, 1)))
        out = part if out is None else out.unionByName(part)
    return out


def strategies_agree(results: DataFrame) -> DataFrame:
    """(qid, agree): whether all strategies of a batch found the same distance."""
    d = F.coalesce("distance", F.lit(-1))
    return results.groupBy("qid").agg((F.min(d) == F.max(d)).alias("agree"))


def limited(results: DataFrame, answered: int, failed: int = 30) -> DataFrame:
    """Of (qid, ..., distance), those that a driver runs that stops after ``answered`` reachable or ``failed`` unreachable ones.

    Where a driver stops is the qid of the answered-th or failed-th row of its
    kind: two bounded heaps, and no window over the workload.
    """
    stop = None
    for n, kind in ((answered, "distance is not null"), (failed, "distance is null")):
        last = results.where(kind).select("qid").orderBy("qid").limit(n).agg(F.when(F.count("*") == n, F.max("qid")).alias("at"))
        stop = last if stop is None else stop.unionByName(last)
    stop = stop.agg(F.min("at").alias("at"))
    return results.join(F.broadcast(stop)).where("at is null or qid <= at").drop("at")  # one row


def search_rounds(edges: DataFrame, queries: DataFrame, *, local_edges=0) -> DataFrame:
    """(qid, labels, rounds): how many vertices the search from the source labelled, and when the last label changed."""
    labels = search(edges, _forward(queries), local_edges=local_edges)
    return labels.groupBy(F.col("q").alias("qid")).agg(F.count("*").alias("labels"), F.max("round").alias("rounds"))
