"""Graphs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.ordering import lead
from weftline.plans.stages import Stages


def _hops(rows: DataFrame, vertex: str, *keys) -> DataFrame:
    """(src, dst, w): each row's vertex to that of the next row in the order of the keys."""
    pairs = lead(rows.select(F.col(vertex).cast("long").alias("src"), *keys), "src", *keys, name="dst")
    edges = pairs.where("dst is not null and src <> dst").select("src", "dst").distinct()
    return edges.withColumn("w", 1 + (7 * F.col("src") + 13 * F.col("dst")) % 20)


def order_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the order of their orders: the flagship graph, staged."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return Stages(spark).write(_hops(orders, "o_custkey", F.col("o_orderdate"), F.col("o_orderkey")))


def event_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the order of their events, staged."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Stages(spark).write(_hops(events, "user_id", F.col("ts"), F.col("event_id")))


def _hops_sql(table: str, vertex: str, keys: str) -> str:
    return f"""e AS MATERIALIZED (
  SELECT src, dst, 1 + (7 * src + 13 * dst) % 20 AS w FROM (
    SELECT DISTINCT src, dst FROM (
      SELECT CAST({vertex} AS BIGINT) AS src, CAST(lead({vertex}) OVER (ORDER BY {keys}) AS BIGINT) AS dst FROM {table}
    ) WHERE dst IS NOT NULL AND src <> dst
  )
)"""


ORDER_HOPS = _hops_sql("orders", "o_custkey", "o_orderdate, o_orderkey")
EVENT_HOPS = _hops_sql("events", "user_id", "ts, event_id")
