"""Graphs as edge DataFrames (src long, dst long, w long): normal forms, degrees, adjacency, one round of relaxation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A distance that text sinks print for unreachable vertices (fixed value).
UNREACHABLE = 10_000_000


def edges_of(rows: DataFrame, src="src", dst="dst", w: str | None = "w") -> DataFrame:
    """Edge rows with long columns; weight 1 where there is no weight column."""
    weight = F.lit(1).cast("long") if w is None or w not in rows.columns else F.col(w).cast("long")
    return rows.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), weight.alias("w"))


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge of each (src, dst): that with the least weight."""
    return edges.groupBy("src", "dst").agg(F.min("w").alias("w"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def symmetrize(edges: DataFrame) -> DataFrame:
    """The undirected view: each edge both ways, least weights."""
    return dedup_edges(edges.unionByName(reverse(edges)))


def vertices(edges: DataFrame) -> DataFrame:
    """(v): every id that is an endpoint."""
    return edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def _degree(edges: DataFrame, own: str, within: DataFrame | None) -> DataFrame:
    # an endpoint of the other side counts 0, so one aggregation gives vertices and degrees
    ends = edges.select(F.explode(F.array(F.struct(F.col(own).alias("v"), F.lit(1).alias("n")), F.struct(F.col("dst" if own == "src" else "src").alias("v"), F.lit(0).alias("n")))).alias("e"))
    ends = ends.select("e.v", "e.n")
    if within is not None:
        ends = ends.unionByName(within.select("v", F.lit(0).alias("n")))
    return ends.groupBy("v").agg(F.sum("n").alias("degree"))


def out_degree(edges: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(v, degree), 0 for vertices without out-edges; ``within`` adds isolated vertices."""
    return _degree(edges, "src", within)


def in_degree(edges: DataFrame, within: DataFrame | None = None) -> DataFrame:
    return _degree(edges, "dst", within)


def degree_groups(degrees: DataFrame) -> DataFrame:
    """(degree, vertices array): the vertices of each degree, ascending."""
    return degrees.groupBy("degree").agg(F.array_sort(F.collect_list("v")).alias("vertices"))


def top_degree(degrees: DataFrame, k: int) -> DataFrame:
    """The k vertices of greatest degree, ties by id: a bounded heap in each task, no global sort."""
    return degrees.orderBy(F.desc("degree"), "v").limit(k)


def adjacency(edges: DataFrame) -> DataFrame:
    """(v, neighbours array<struct<dst, w>>), neighbours ascending."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("neighbours"))


def adjacency_text(edges: DataFrame, weighted: bool) -> DataFrame:
    """(v, line): the neighbours, or (neighbour, weight) pairs, of each vertex as text."""
    show = (lambda e: F.concat(F.lit("("), e["dst"], F.lit(","), e["w"], F.lit(")"))) if weighted else (lambda e: e["dst"].cast("string"))
    return adjacency(edges).select("v", F.concat_ws(" ", F.transform("neighbours", show)).alias("line"))


def expand(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w) of the edges that leave the frontier's vertices (v)."""
    return edges.join(frontier.select(F.col("v").alias("src")), "src", "left_semi")


def expand_reverse(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w) of the edges that enter them."""
    return edges.join(frontier.select(F.col("v").alias("dst")), "dst", "left_semi").select("src", "dst", "w")


def relax(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, d) after one round: for each vertex the least of its label and what its in-edges offer."""
    offers = labels.join(edges, F.col("v") == F.col("src")).select(F.col("dst").alias("v"), (F.col("d") + F.col("w")).alias("d"))
    return labels.select("v", "d").unionByName(offers).groupBy("v").agg(F.min("d").alias("d"))


def closest(labels: DataFrame, among: Column | None = None) -> DataFrame:
    """The (v, d) of least distance, ties by id."""
    rows = labels if among is None else labels.where(among)
    return rows.agg(F.min(F.struct("d", "v")).alias("m")).where("m is not null").select("m.v", "m.d")
