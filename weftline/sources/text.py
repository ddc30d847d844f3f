"""Text formats: edge lists, query pairs, adjacency rows, distances, paths, ranks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.hashing import pseudo
from weftline.operators.graph import UNREACHABLE, adjacency
from weftline.plans.stages import Stages


def _tokens() -> Column:
    """What white space separates in a line."""
    return F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")


def _numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, t): the tokens of the lines that are not blank, numbered from 0 by file, block and place in it: Spark reads large files first."""
    from weftline.operators.ordering import rank

    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select(*block, F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.where(F.trim("value") != "").select("file", "start", "at", _tokens().alias("t"))
    return rank(lines, F.col("file"), F.col("start"), F.col("at"), name=name, start=0).select(name, "t")


def synth_weight(bound: int = 3):
    """A weight from 1 to ``bound`` for an edge (src, dst) that has none."""
    noise = pseudo(F.abs(F.col("src")) * 31 + F.abs(F.col("dst")), 5) % 100
    return F.pmod(F.col("src") + F.col("dst") + noise, F.lit(bound)) + 1


@dataclass
class EdgeList:
    """What an edge-list file holds: edges (src, dst, w), and the lines that are none."""

    edges: DataFrame
    rejects: DataFrame


def read_edge_list(spark: SparkSession, path: str, bound: int = 3) -> EdgeList:
    """``src dst [w]`` lines. Lines that begin with % or # are skipped, self loops dropped, a missing weight made up."""
    lines = spark.read.text(path).where(~F.col("value").rlike("^[%#]") & (F.trim("value") != "")).withColumn("t", _tokens())
    numbers = F.forall("t", lambda x: x.rlike(r"^-?\d+$"))
    good = F.size("t").isin(2, 3) & numbers
    rows = lines.where(good).select(F.col("t")[0].cast("long").alias("src"), F.col("t")[1].cast("long").alias("dst"), F.get("t", F.lit(2)).cast("long").alias("w"))
    edges = rows.where("src <> dst").select("src", "dst", F.coalesce("w", synth_weight(bound)).alias("w"))
    return EdgeList(edges, lines.where(~good).select(F.col("value").alias("line")))


def read_unweighted(spark: SparkSession, path: str) -> DataFrame:
    """Edges (src, dst, w = 1) from a stream of tokens, two an edge, whatever the lines; an odd last token is none.

    Lines are numbered in the order of files and blocks, tokens by the sums of
    lines before: a window over each block of a file, one number a block beyond.
    """
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select(where.alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = Stages(spark).write(lines.where(F.trim("value") != "").select("block", "at", _tokens().alias("t")))
    sums, before = [], 0
    for r in lines.groupBy("block").agg(F.sum(F.size("t")).alias("n")).orderBy("block").collect():  # a row for each block of a file
        sums.append(((r.block.file, r.block.start), before))
        before += r.n
    sums = F.broadcast(spark.createDataFrame(sums, "block struct<file string, start long>, before long"))
    inside = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum(F.size("t")).over(inside), F.lit(0))
    lines = lines.join(sums, "block").withColumn("first", first)
    tokens = lines.select("first", F.posexplode("t").alias("i", "token")).select((F.col("first") + F.col("i")).alias("k"), F.col("token").cast("long").alias("v"))
    ends = [F.max(F.when(F.col("k") % 2 == side, F.col("v"))).alias(name) for side, name in enumerate(("src", "dst"))]
    pairs = tokens.where(F.col("k") < before - before % 2).groupBy(F.expr("k div 2").alias("edge")).agg(*ends)
    return pairs.select("src", "dst", F.lit(1).cast("long").alias("w"))


def read_query_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(qid, src, dst): a pair a line, numbered by place in the file."""
    t = F.col("t")
    return _numbered(spark, path, "qid").select("qid", t[0].cast("long").alias("src"), t[1].cast("long").alias("dst"))


@dataclass
class AdjacencyFile:
    """An adjacency file: its header, and edges with ids from 1."""

    vertices: int
    source: int
    edges: DataFrame


def read_adjacency(spark: SparkSession, path: str) -> AdjacencyFile:
    """Header ``V s`` and then, for each vertex in order, ``deg (neighbour weight)*``; ids in the file begin with 0."""
    lines = _numbered(spark, path, "v")  # the header is line 0, vertex i is line i
    head = lines.where("v = 0").first()
    if head is None:
        raise ValueError(f"{path} is empty")
    rows = lines.where((F.col("v") > 0) & (F.col("t")[0].cast("int") > 0))
    parts = rows.select("v", "t", F.explode(F.sequence(F.lit(0), F.col("t")[0].cast("int") - 1)).alias("i"))
    at = F.col("i") * 2 + 1
    edges = parts.select(F.col("v").alias("src"), (F.col("t")[at].cast("long") + 1).alias("dst"), F.col("t")[at + 1].cast("long").alias("w"))
    return AdjacencyFile(int(head.t[0]), int(head.t[1]) + 1, edges)


def adjacency_lines(edges: DataFrame, vertices: int) -> DataFrame:
    """(v, line) in the format of ``read_adjacency``, for the vertices 1 to V; the header is not among them."""
    spark = edges.sparkSession
    every = spark.range(1, vertices + 1).toDF("v")
    rows = every.join(adjacency(edges), "v", "left")
    parts = F.transform("neighbours", lambda e: F.concat_ws(" ", (e["dst"] - 1).cast("string"), e["w"].cast("string")))
    n = F.coalesce(F.size("neighbours"), F.lit(0))
    return rows.select("v", F.concat_ws(" ", F.when(F.col("neighbours").isNull(), "0").otherwise(n.cast("string")), parts).alias("line"))


def write_adjacency(edges: DataFrame, vertices: int, source: int, path: str) -> None:
    """Header and lines in order, as text part files."""
    spark = edges.sparkSession
    head = spark.createDataFrame([(0, f"{vertices} {source - 1}")], "v long, line string")
    head.unionByName(adjacency_lines(edges, vertices)).orderBy("v").select("line").write.mode("overwrite").text(path)


def distance_lines(distances: DataFrame) -> DataFrame:
    """(v, line) ``v dist`` for rows (v, d); unreachable vertices get the sentinel."""
    return distances.select("v", F.concat_ws(" ", "v", F.coalesce("d", F.lit(UNREACHABLE))).alias("line"))


def write_distances(distances: DataFrame, path: str) -> None:
    distance_lines(distances).orderBy("v").select("line").write.mode("overwrite").text(path)


def path_lines(paths: DataFrame) -> DataFrame:
    """(qid, line) ``src->dst, distance, v1;v2;...;`` for rows (qid, src, dst, distance, path)."""
    spelled = F.concat(F.concat_ws(";", F.transform("path", lambda v: v.cast("string"))), F.when(F.size("path") > 0, ";").otherwise(""))
    return paths.select("qid", F.concat_ws(", ", F.concat_ws("->", "src", "dst"), F.coalesce("distance", F.lit(UNREACHABLE)), spelled).alias("line"))


def write_paths(paths: DataFrame, path: str) -> None:
    path_lines(paths).orderBy("qid").select("line").write.mode("overwrite").text(path)


def write_ranks(ranks: DataFrame, steps: int, path: str) -> None:
    """``v rank`` lines in order, and the number of steps last."""
    lines = ranks.select("v", F.concat_ws(" ", "v", F.format_string("%.6f", "pr")).alias("line"))
    last = ranks.sparkSession.createDataFrame([((1 << 63) - 1, str(steps))], "v long, line string")
    lines.unionByName(last).orderBy("v").select("line").write.mode("overwrite").text(path)


def write_array(rows: DataFrame, value: str, path: str) -> None:
    rows.orderBy(value).select(F.col(value).cast("string")).write.mode("overwrite").text(path)
