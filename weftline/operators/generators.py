"""Deterministic graphs, arrays and query pairs from ids and a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.hashing import MODULUS, pseudo
from weftline.operators.ordering import rank

#: Vertex counts that generated graphs may have, and the greatest weight (fixed values).
LEAST, MOST, WEIGHT = 11, 10_000_000, 20


def check_size(v: int, e: int | None = None) -> int:
    """The number of edges to generate: 5 V - 1 unless given; raises ValueError for what no connected simple graph has."""
    if not LEAST <= v <= MOST:
        raise ValueError(f"the number of vertices must be {LEAST} to {MOST}, not {v}")
    e = 5 * v - 1 if e is None else e
    if e < v - 1:
        raise ValueError(f"{v} vertices need at least {v - 1} edges to be connected, not {e}")
    if e > v * (v - 1) // 2:
        raise ValueError(f"{v} vertices have at most {v * (v - 1) // 2} edges, not {e}")
    return e


def _candidates(spark: SparkSession, v: int, n: int, seed: int) -> DataFrame:
    """(id, a, b) of n pseudo-random pairs without self loops."""
    rows = spark.range(n).select("id", (pseudo("id", seed) % v + 1).alias("a"), (pseudo(F.col("id") + MODULUS // 3, seed + 1) % v + 1).alias("b"))
    return rows.where("a <> b")


def weight(src, dst, seed: int = 0):
    """1 to WEIGHT."""
    return pseudo(src * 31 + dst * 17, seed + 2) % WEIGHT + 1


def undirected(spark: SparkSession, v: int, e: int | None = None, seed: int = 0) -> DataFrame:
    """(src, dst, w), each edge both ways: the path 1-2-...-V and e - (V - 1) different random edges.

    Candidates are drawn until enough differ; of these the first by a hash stay.
    """
    need = check_size(v, e) - (v - 1)
    path = spark.range(1, v).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    half = path.unionByName(_distinct(spark, v, need, seed, ordered=False)) if need else path
    half = half.withColumn("w", weight(F.col("src"), F.col("dst"), seed))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def directed(spark: SparkSession, v: int, e: int | None = None, seed: int = 0) -> DataFrame:
    """(src, dst, w) of e different random directed edges; not always connected."""
    out = _distinct(spark, v, check_size(v, e), seed, ordered=True)
    return out.withColumn("w", weight(F.col("src"), F.col("dst"), seed))


def _distinct(spark: SparkSession, v: int, need: int, seed: int, ordered: bool) -> DataFrame:
    """``need`` different pairs; for unordered ones a < b, and no neighbours of the path."""
    n = 2 * need + 16
    while True:
        rows = _candidates(spark, v, n, seed)
        if not ordered:
            rows = rows.select("id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("b - a > 1")
        found = rows.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min("id").alias("id"))
        if found.count() >= need:
            place = rank(found, F.col("id"))
            return place.where(F.col("rank") <= need).select("src", "dst")
        n *= 2


def complete(spark: SparkSession, n: int) -> DataFrame:
    """(src, dst) of K_n."""
    i, j = spark.range(1, n + 1).toDF("src"), spark.range(1, n + 1).toDF("dst")
    return i.join(j, F.col("src") != F.col("dst"))


def complete_pair(spark: SparkSession, n: int) -> DataFrame:
    """(g, src, dst): K_n and K_(n-1)."""
    return complete(spark, n).withColumn("g", F.lit(1)).unionByName(complete(spark, n - 1).withColumn("g", F.lit(2))).select("g", "src", "dst")


def skew_pair(spark: SparkSession, n: int) -> DataFrame:
    """(g, src, dst): vertex 1 joined to all and even vertices to each other; and K_n."""
    k = complete(spark, n)
    one = k.where("src = 1 or dst = 1 or (src % 2 = 0 and dst % 2 = 0)")
    return one.withColumn("g", F.lit(1)).unionByName(k.withColumn("g", F.lit(2))).select("g", "src", "dst")


def array(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(pos, value) of n integers from 1 to 100."""
    return spark.range(n).select(F.col("id").alias("pos"), (pseudo("id", seed) % 100 + 1).cast("int").alias("value"))


def random_pairs(vertices: DataFrame, n: int = 100, seed: int = 0) -> DataFrame:
    """(qid, src, dst) of n pseudo-random pairs of vertices (v)."""
    spark = vertices.sparkSession
    ranked = rank(vertices.select("v"), F.col("v"), start=0)
    total = vertices.count()
    if not total:
        return spark.createDataFrame([], "qid long, src long, dst long")
    picks = spark.range(n).select(F.col("id").alias("qid"), (pseudo("id", seed) % total).alias("i"), (pseudo("id", seed + 1) % total).alias("j"))
    a, b = ranked.toDF("src", "i"), ranked.toDF("dst", "j")
    return a.join(F.broadcast(picks), "i").select("qid", "src", "j").join(b, "j").select("qid", "src", "dst")
