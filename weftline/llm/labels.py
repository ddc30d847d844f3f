"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, train: Column, most: int) -> DataFrame:
    """(text, y, pick, hash) of about ``most`` labelled training documents, or of all if there are fewer.

    Labels of documents that ``docs`` doesn't hold aren't counted.
    Rows are taken by a hash of doc_id, alike at every size. ``train`` is an
    expression over doc_id. Labels that are null, and rows without an id, are
    left out; where a document has several labels, the largest counts. Of an id
    with several rows all are returned; ``one_each`` leaves one of what is made
    of them, so that the sample is bounded whatever is repeated.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
        .where("doc_id is not null and y is not null")
        .where(train)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .withColumn("pick", F.xxhash64("doc_id", F.lit(target)))
    )
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = known.join(held, "doc_id", "left_semi")
    n = known.count()
    if n > most:
        known = known.where(F.pmod("pick", F.lit(1 << 30)) < int((1 << 30) * most / n))
    # about ``most`` rows of three numbers, whatever the size of the tables
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return texts.join(F.broadcast(known), "doc_id").select("text", "y", "pick", F.xxhash64("text").alias("hash"))


def one_each(rows: DataFrame, value: str) -> DataFrame:
    """(y, pick, value) with one row for each sampled document: that of the text with the smallest hash."""
    own = rows.groupBy("pick", "y").agg(F.min(F.struct("hash", value)).alias("own"))
    return own.select("y", "pick", F.col(f"own.{value}").alias(value))


def part(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus
