"""Global order: sorting, ranks, neighbours in order, top-k, merging sorted runs.

No operator uses a window over all rows: rows are dealt by range, each range is
sorted on its own, and only one number per range passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from weftline.plans.stages import Stages


def sort_global(rows: DataFrame, *keys) -> DataFrame:
    """Rows in order; ties keep the order of later keys, so pass the position as the last key for a stable sort."""
    return rows.orderBy(*keys)


def sort_partitioned(rows: DataFrame, n: int, *keys) -> DataFrame:
    """n ranges in order, each sorted: what a parallel writer wants."""
    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def merge_runs(left: DataFrame, right: DataFrame, key: str, pos: str) -> DataFrame:
    """Two runs as one: (run, pos, key) in order, rows of the left run first among equals."""
    both = left.select(F.lit(0).alias("run"), pos, key).unionByName(right.select(F.lit(1).alias("run"), pos, key))
    return both.orderBy(key, "run", pos)


def top_k(rows: DataFrame, k: int, *keys) -> DataFrame:
    """The first k rows: a bounded heap in each task."""
    return rows.orderBy(*keys).limit(k)


class _Ranges:
    """Rows dealt by range of the keys and staged, with each range's number ``_range``."""

    def __init__(self, rows: DataFrame, keys: tuple):
        spark = rows.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        names = [f"_k{i}" for i in range(len(keys))]
        keyed = rows.withColumns(dict(zip(names, keys, strict=True)))
        self.keys = [F.col(n) for n in names]
        self.names = names
        self.rows = Stages(spark).write(keyed.repartitionByRange(n, *self.keys).withColumn("_range", F.spark_partition_id()))
        self.spark = spark
        self.window = Window.partitionBy("_range").orderBy(*self.keys)


def rank(rows: DataFrame, *keys: Column, name="rank", start=1) -> DataFrame:
    """Rows with their place in the order of the keys, which must tell all rows apart."""
    dealt = _Ranges(rows, keys)
    before, total = [], start
    for r in dealt.rows.groupBy("_range").count().orderBy("_range").collect():  # a row for each range
        before.append((r["_range"], total))
        total += r["count"]
    offsets = F.broadcast(dealt.spark.createDataFrame(before, "_range int, _before long"))  # as many rows
    place = F.row_number().over(dealt.window) - 1 + F.col("_before")
    return dealt.rows.join(offsets, "_range").withColumn(name, place.cast("long")).drop("_range", "_before", *dealt.names)


def lead(rows: DataFrame, value: str, *keys: Column, name="next") -> DataFrame:
    """Rows with the next row's value in the order of the keys; null in the last row."""
    dealt = _Ranges(rows, keys)
    firsts = dealt.rows.groupBy("_range").agg(F.min_by(value, F.struct(*dealt.names)).alias("v")).orderBy("_range").collect()
    kind = dealt.rows.schema[value].dataType
    after = [(a["_range"], b["v"]) for a, b in zip(firsts, firsts[1:], strict=False)]
    schema = StructType([StructField("_range", IntegerType()), StructField("_after", kind)])
    first_after = F.broadcast(dealt.spark.createDataFrame(after, schema))  # a row for each range but the last
    following = F.lead(F.struct(F.col(value).alias("v"))).over(dealt.window)  # null in the last row of a range only
    out = dealt.rows.withColumn("_next", following).join(first_after, "_range", "left")
    found = F.when(F.col("_next").isNull(), F.col("_after")).otherwise(F.col("_next.v"))
    return out.withColumn(name, found).drop("_range", "_after", "_next", *dealt.names)
