"""A corpus pipeline: quality, toxicity, repeated lines, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import free_name
from weftline.llm.jaccard_join import jaccard_join
from weftline.llm.labels import part
from weftline.llm.line_dedup import dedup_lines
from weftline.llm.packing import best_fit_pack
from weftline.llm.quality import fit_quality, score_quality
from weftline.llm.toxicity import fit_toxicity, score_toxicity
from weftline.plans.stages import Stages

#: SQL cannot express the classifiers; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns as c0, c1, ..., so that no name can clash, and what each name became."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.7, with the columns of ``docs``.

    A null text is scored as an empty one; very long texts are scored whole.
    Rows are judged one by one, so repeated rows fare alike. An empty table gives
    an empty one. Without any label at hand nothing is rejected. Other columns
    may have any names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels, part(4) != 2)
    if not len(model.knots):
        return docs
    score = free_name(docs, "quality")
    return score_quality(docs, model, score_col=score).where(F.col(score) >= 0.7).select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, with the columns of ``docs``.

    A null text is scored as an empty one; very long texts are scored whole.
    Rows are judged one by one, so repeated rows fare alike. An empty table gives
    an empty one. Without any label at hand nothing is rejected. Other columns
    may have any names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = fit_toxicity(docs, labels, part(5) != 0)
    score = free_name(docs, "toxicity")
    return score_toxicity(docs, weights, score_col=score).where(F.col(score) < 0.5).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines of 50 words, with the columns of ``docs``.

    Documents that lose every line go; those without any line, such as null,
    empty and blank texts, stay. Of rows with one id and text all but one are
    later copies. n_chars is counted anew where lines went. Very long texts are
    taken line by line. An empty table gives an empty one. Other columns may have
    any names.
    """
    plain, at = _renamed(docs)
    out = dedup_lines(plain, min_words=50, id_col=at["doc_id"], text_col=at["text"]).where("n_deleted = 0 or n_deleted < n_lines")
    if "n_chars" in at:
        length = F.when(F.col("n_deleted") > 0, F.length(at["text"])).otherwise(F.col(at["n_chars"]))
        out = out.withColumn(at["n_chars"], length.cast(docs.schema["n_chars"].dataType))
    return out.select(plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id, then the smallest hash of its columns.

    Rows are compared, not ids: different texts that share an id all stay. Rows
    without an id stay, and so do texts without words (null, empty, blank). Of
    repeated rows one stays. Very long texts are compared whole. An empty table
    gives an empty one. Other columns may have any names.
    """
    plain, at = _renamed(docs)
    key, text = at["doc_id"], at["text"]
    known = plain.where(F.col(key).isNotNull())
    if known.groupBy(key).count().where("count > 1").isEmpty():
        gone = jaccard_join(plain, threshold=0.8, words=5, id_col=key, text_col=text).where("not kept").select(F.col("doc_id").alias(key))
        return plain.join(gone, key, "left_anti").select(plain.columns).toDF(*docs.columns)
    rows = Stages(spark).write(plain.withColumn("row", F.monotonically_increasing_id()))  # written, so the numbers hold
    known = rows.where(F.col(key).isNotNull())
    linked = jaccard_join(known, threshold=0.8, words=5, id_col="row", text_col=text).where("n_links > 0").select(F.col("doc_id").alias("row"), "class_id")
    order = known.select("row", F.struct(key, F.xxhash64(*plain.columns).alias("hash"), "row").alias("order"))
    first = linked.join(order, "row").groupBy("class_id").agg(F.min("order").alias("order")).select("order.row")
    gone = linked.select("row").join(first, "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select(plain.columns).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, bin, position) in bins of 2048 words.

    Null and empty texts are pieces of length 0; very long texts are cut into
    pieces; repeated rows are documents of their own; an empty table gives an
    empty result. Other columns may have any names.
    """
    return best_fit_pack(docs, capacity=2048)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each is written as Parquet and read again by the next."""
    stages = Stages(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = None
    for _, stage in STAGES:
        docs = stages.write(stage(spark, docs, sf_dir))
        if done is not None:
            stages.drop(done)
        done = docs
    return docs
