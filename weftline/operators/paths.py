"""Single-source shortest paths, one semantic for all: least sums of weights (each at least 1); unreachable is null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import reverse, vertices
from weftline.plans.fixpoint import search


def _seeds(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, "q long, dir int, v long, d long, bound long, target long")


def _labels(edges: DataFrame, source: int, direction: int = 0, local_edges: int = 0) -> DataFrame:
    seeds = _seeds(edges.sparkSession, [(0, direction, int(source), 0, None, None)])
    return search(edges, seeds, local_edges=local_edges).select("v", "d", "round")


def _every(edges: DataFrame, found: DataFrame, within: DataFrame | None, column="d") -> DataFrame:
    """``found`` with null for vertices that it lacks."""
    all_ = vertices(edges) if within is None else vertices(edges).unionByName(within.select("v")).distinct()
    return all_.join(found.select("v", column), "v", "full_outer")


def sssp(edges: DataFrame, source: int, *, within: DataFrame | None = None, local_edges: int = 0) -> DataFrame:
    """(v, d) from the source to every vertex; ``within`` adds isolated vertices."""
    return _every(edges, _labels(edges, source, 0, local_edges), within)


def sssp_to(edges: DataFrame, target: int, *, within: DataFrame | None = None, local_edges: int = 0) -> DataFrame:
    """(v, d) from every vertex to the target."""
    return _every(edges, _labels(edges, target, 1, local_edges), within)


def bfs_hops(edges: DataFrame, source: int, *, within: DataFrame | None = None, local_edges: int = 0) -> DataFrame:
    """(v, d): the least number of edges."""
    return sssp(edges.withColumn("w", F.lit(1).cast("long")), source, within=within, local_edges=local_edges)


def tree(edges: DataFrame, source: int, *, local_edges: int = 0) -> DataFrame:
    """(v, d, pred) of reached vertices: pred is the smallest vertex from which a shortest path comes."""
    found = _labels(edges, source, 0, local_edges).select("v", "d")
    tight = (
        edges.join(found.select(F.col("v").alias("src"), F.col("d").alias("d_src")), "src")
        .join(found.select(F.col("v").alias("dst"), F.col("d").alias("d_dst")), "dst")
        .where("d_src + w = d_dst")
    )
    preds = tight.groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("pred"))
    return found.join(preds, "v", "left")


def reachable(edges: DataFrame, source: int, **options) -> DataFrame:
    return sssp(edges, source, **options).where("d is not null").select("v")


def unreachable(edges: DataFrame, source: int, **options) -> DataFrame:
    return sssp(edges, source, **options).where("d is null").select("v")


def eccentricity(edges: DataFrame, source: int, **options) -> DataFrame:
    """(source, eccentricity): the greatest distance."""
    return sssp(edges, source, **options).agg(F.lit(source).cast("long").alias("source"), F.max("d").alias("eccentricity"))


def rounds(edges: DataFrame, source: int, *, local_edges: int = 0) -> DataFrame:
    """(round, settled): vertices whose distance was last improved in each round of the synchronous search."""
    return _labels(edges, source, 0, local_edges).groupBy("round").agg(F.count("*").alias("settled"))


__all__ = ["bfs_hops", "eccentricity", "reachable", "reverse", "rounds", "sssp", "sssp_to", "tree", "unreachable"]
