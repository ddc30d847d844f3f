"""PageRank, not normalised: every vertex begins with 1, and ranks are (1 - d) + d * sum(rank / out-degree).

Rank flows along src -> dst. The rank of a vertex without out-edges is lost.
Converged when no rank moves by more than eps; the result is the iterate before
the step that confirms this. Ranks depend on the order of sums in their last
bits only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftline.operators.graph import out_degree, vertices
from weftline.plans.stages import Stages

DAMPING, EPSILON = 0.85, 0.001


def initial(edges: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(v, pr = 1.0)."""
    every = vertices(edges) if within is None else vertices(edges).unionByName(within.select("v")).distinct()
    return every.select("v", F.lit(1.0).alias("pr"))


def _links(edges: DataFrame) -> DataFrame:
    """(src, dst, share): what part of its rank src gives to dst."""
    degree = out_degree(edges).where("degree > 0").select(F.col("v").alias("src"), F.col("degree"))
    return edges.select("src", "dst").join(degree, "src").select("src", "dst", (F.lit(1.0) / F.col("degree")).alias("share"))


def _step(ranks: DataFrame, links: DataFrame, damping: float) -> DataFrame:
    """(v, pr, before): a vertex's own rank travels with what it is given, so one shuffle brings both together."""
    given = ranks.join(links, F.col("v") == F.col("src")).select(F.col("dst").alias("v"), (F.col("pr") * F.col("share")).alias("s"), F.lit(None).cast("double").alias("before"))
    own = ranks.select("v", F.lit(0.0).alias("s"), F.col("pr").alias("before"))
    sums = given.unionByName(own).groupBy("v").agg(F.sum("s").alias("s"), F.max("before").alias("before")).where("before is not null")
    return sums.select("v", (F.lit(1 - damping) + F.lit(damping) * F.col("s")).alias("pr"), "before")


def pagerank_step(ranks: DataFrame, edges: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(v, pr) after one step."""
    return _step(ranks, _links(edges), damping).select("v", "pr")


class Run:
    """Ranks (v, pr), the number of steps with the confirming one, and the trace (step, delta)."""

    def __init__(self, ranks: DataFrame, trace: list[tuple[int, float]]):
        self.ranks = ranks
        self.trace = ranks.sparkSession.createDataFrame(trace, "step int, delta double")
        self.steps = len(trace)


def pagerank(
    edges: DataFrame, *, damping=DAMPING, eps: float | None = EPSILON, steps: int | None = None, within: DataFrame | None = None,
) -> Run:
    """To convergence, or with ``eps`` None for exactly ``steps`` steps, of which the last iterate is returned.

    Links are dealt once by their source; a step shuffles the ranks and what
    vertices give each other, combined before the shuffle. Each step's ranks are
    a staged table, so a lost executor costs a step.
    """
    spark = edges.sparkSession
    stages = Stages(spark)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = stages.write(edges.select("src", "dst"))
    links = _links(edges).repartition(width, "src").sortWithinPartitions("src").persist()
    ranks, trace = stages.write(initial(edges, within)), []
    while steps is None or len(trace) < steps:
        seen = Observation()
        after = _step(ranks.select("v", "pr"), links, damping)
        after = stages.write(after.observe(seen, F.max(F.abs(F.col("pr") - F.col("before"))).alias("delta")))
        delta = seen.get["delta"] or 0.0
        trace.append((len(trace) + 1, delta))
        if eps is not None and delta <= eps:
            stages.drop(after)
            break
        stages.drop(ranks)
        ranks = after
    links.unpersist()
    return Run(ranks.select("v", "pr"), trace)
