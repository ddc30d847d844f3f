"""Repeated runs of lines by a distributed suffix array (operator 2)."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import FILTER_BITS, passes, ranked, releasing, slot_filter, take, text_parts
from weftline.plans.stages import Stages

_LAST = (1 << 63) - 1
_LINES = "num long, doc long, row string, i int, line binary, runs array<int>"


def dedup_lines(docs: DataFrame, *, min_words=50, id_col="doc_id", text_col="text") -> DataFrame:
    """All columns of ``docs``, texts without later copies of repeated runs of lines, with n_lines and n_deleted.

    A run of neighbouring lines of one document is deleted where it has at least
    ``min_words`` words and the same lines stand in a row at an earlier place, in
    the order of (doc_id, hash of the text, line). Lines are compared without the
    white space around them; blank lines are no part of runs and stay. Within a
    text that repeats itself, copies may overlap.

    The suffixes of the documents' line sequences are sorted by prefix doubling,
    a round of Spark jobs for each power of two (see ``suffix_ranks``). Suffixes
    whose prefix occurs nowhere else leave, so a round costs what repeats. Two
    suffixes are in one interval of common prefix length n if their ranks by the
    first and by the last 2^j of n lines agree, 2^j being the greatest power of
    two in n. Every maximal repeated run is the union of the shortest runs of
    ``min_words`` words from each of its lines on and up to each of its lines,
    and equal runs have equal lengths, so the intervals at these lengths say
    which lines go: the first place of each interval stays, all others go. For
    the same reason suffixes need to be sorted no deeper than the longest of
    these runs, at most ``min_words`` lines.

    n_lines counts lines that are not blank; a null text stays null and has none.
    Very long texts are cut into lines one batch of texts at a time. Of rows that
    share id and text, all but one are later copies; rows without an id are
    documents of their own that come last. An empty table gives an empty result.
    Other columns pass through under any names; columns n_lines and n_deleted
    are replaced.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    docs = docs.drop("n_lines", "n_deleted")
    names = docs.columns
    text = f"c{names.index(text_col)}"
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # no name of the input can clash
    doc, digest = F.coalesce(F.col(f"c{names.index(id_col)}").cast("long"), F.lit(_LAST)), F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    keyed = plain.withColumns({"doc": doc, "row": digest}).withColumn("slot", F.pmod(F.xxhash64("doc", "row"), F.lit(FILTER_BITS)))

    lines = stages.write(keyed.select("doc", "row", F.col(text).alias("text")).mapInArrow(partial(_lines, min_words=min_words), _LINES))
    heads = lines.where("i = 0").select("doc", "row", "num")
    copied = stages.write(heads.groupBy("doc", "row").agg(F.min("num").alias("keep"), F.count("*").alias("n")).where("n > 1"))
    repeats = not copied.isEmpty()
    own = lines
    if repeats:
        own = lines.join(heads.join(copied, ["doc", "row"]).where("num <> keep").select("num"), "num", "left_anti")
    spans = repeated_spans(stages, own)
    marks = spans.join(heads, "num").select("doc", "row", "spans", F.lit(False).alias("copied"))
    if repeats:  # copies of a row lose all of their lines if these are a run that counts
        long = lines.where("size(runs) > 0").select("num").distinct()
        whole = copied.select("doc", "row", F.col("keep").alias("num")).join(long, "num", "left_semi")
        whole = whole.select("doc", "row", F.array().cast(marks.schema["spans"].dataType).alias("spans"), F.lit(True).alias("copied"))
        marks = marks.unionByName(whole).groupBy("doc", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.max("copied").alias("copied"))
    marks = stages.write(marks)
    bits = spark.sparkContext.broadcast(slot_filter(marks.select(F.pmod(F.xxhash64("doc", "row"), F.lit(FILTER_BITS)).alias("slot"))))
    stages.drop(lines, copied)

    schema = plain.withColumns({"n_lines": F.lit(0).cast("int"), "n_deleted": F.lit(0).cast("int")}).schema
    at, width = names.index(text_col), len(names)
    flagged = keyed.mapInArrow(partial(_choose, bits=bits, flagged=True), keyed.schema)
    if repeats:
        flagged = stages.write(flagged.withColumn("num", F.monotonically_increasing_id()))  # written, so the numbers hold
        first = flagged.join(marks.where("copied").select("doc", "row"), ["doc", "row"]).groupBy("doc", "row").agg(F.min("num").alias("first"))
        flagged = flagged.join(stages.write(first), ["doc", "row"], "left").withColumn("later", F.coalesce(F.col("num") != F.col("first"), F.lit(False)))
    else:
        flagged = flagged.withColumn("later", F.lit(False))
    cut = flagged.join(marks.select("doc", "row", "spans"), ["doc", "row"], "left").select(*plain.columns, "spans", "later")
    cut = cut.mapInArrow(partial(_delete, text=at, width=width), schema)
    rest = keyed.select(*plain.columns, "slot").mapInArrow(partial(_unchanged, text=at, width=width, bits=bits), schema)
    return rest.unionByName(cut).toDF(*names, "n_lines", "n_deleted")


def suffix_ranks(stages: Stages, first: DataFrame, most: int) -> list[DataFrame]:
    """[(num, i, r)] for prefixes of 1, 2, 4 ... lines, as long as at most ``most`` lines are covered.

    ``first`` holds the ranks of single lines. Each round sorts the suffixes by
    the ranks of their first and second halves: those that stand next to each
    other with equal halves get one rank, and those whose prefix occurs once
    leave. Pairs of ranks are counted before they are sorted, and are joined back
    by keys that adaptive execution can split.
    """
    levels = [first]
    while 2 << (len(levels) - 1) <= most:
        step = 1 << (len(levels) - 1)
        half = levels[-1]
        pairs = stages.write(half.join(half.select("num", (F.col("i") - step).alias("i"), F.col("r").alias("r2")), ["num", "i"]))
        sorted_ = ranked(stages, pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "r", "r2")
        after = stages.write(pairs.join(sorted_, ["r", "r2"]).select("num", "i", F.col("rank").alias("r")))
        stages.drop(pairs, sorted_)
        if after.isEmpty():
            break
        levels.append(after)
    return levels


def repeated_spans(stages: Stages, lines: DataFrame) -> DataFrame:
    """(num, spans array<struct<i, n>>): the runs of each document of which an earlier copy exists.

    ``lines``: (num, doc, row, i, line, runs), a row for each line that is not
    blank; runs are the lengths of the runs that count from the line on.
    """
    alphabet = ranked(stages, lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "line")
    known = stages.write(lines.join(alphabet, "line").select("num", "doc", "row", "i", F.col("rank").alias("r"), "runs"))
    stages.drop(alphabet)
    most = known.agg(F.max(F.array_max("runs"))).first()[0] or 0
    levels = suffix_ranks(stages, known.select("num", "i", "r"), most)
    runs = known.select("num", "doc", "row", "i", "r", F.explode("runs").alias("n"))
    keyed = runs.where("n = 1").select("num", "doc", "row", "i", "n", F.col("r").alias("r1"), F.col("r").alias("r2"))
    if len(levels) > 1:
        every = None
        for k, level in enumerate(levels[1:], 1):
            level = level.select(F.lit(k).alias("k"), "num", F.col("i").alias("at"), F.col("r").alias("rank"))
            every = level if every is None else every.unionByName(level)
        long = runs.where("n > 1").withColumn("k", F.length(F.bin("n")) - 1)
        ends = long.withColumns({"start": F.col("i"), "end": F.col("i") + F.col("n") - F.expr("cast(pow(2, k) as int)")})
        a = every.select("k", "num", F.col("at").alias("start"), F.col("rank").alias("r1"))
        b = every.select("k", "num", F.col("at").alias("end"), F.col("rank").alias("r2"))
        ends = ends.join(a, ["k", "num", "start"]).join(b, ["k", "num", "end"])
        keyed = keyed.unionByName(ends.select("num", "doc", "row", "i", "n", "r1", "r2"))
    keyed = stages.write(keyed)
    place = F.struct("doc", "row", "num", "i")
    intervals = stages.write(
        keyed.groupBy("n", "r1", "r2").agg(F.min(place).alias("first"), F.count("*").alias("size")).where("size > 1").select("n", "r1", "r2", "first.num", "first.i").toDF("n", "r1", "r2", "num0", "i0")
    )
    later = keyed.join(intervals, ["n", "r1", "r2"]).where("num <> num0 or i <> i0")
    return later.groupBy("num").agg(F.collect_set(F.struct("i", "n")).alias("spans"))


@releasing
def _lines(batches, min_words):
    """Each line's digest and the lengths of the shortest runs that count, from it on or up to a later line."""
    num = TaskContext.get().partitionId() << 33
    for batch in batches:
        for lo, hi, texts in text_parts(batch, "text", 1 << 20):
            lines = [[x for line in t.split("\n") if (x := line.strip())] for t in texts]
            counts = np.array(list(map(len, lines)))
            owner = np.repeat(np.arange(hi - lo), counts)
            flat = [x for own in lines for x in own]
            total = np.concatenate([[0], np.cumsum([len(x.split()) for x in flat])]).astype(np.int64)
            ends = np.cumsum(counts)
            end, begin, here = ends[owner], (ends - counts)[owner], np.arange(len(flat))
            up = np.searchsorted(total, total[:-1] + min_words, side="left")  # the run ends before this line
            down = np.searchsorted(total, total[1:] - min_words, side="right") - 1
            ahead, back = up <= end, down >= begin
            runs = np.unique(np.column_stack([np.concatenate([here[ahead], down[back]]), np.concatenate([up[ahead], here[back] + 1])]), axis=0)
            starts = np.searchsorted(runs[:, 0], np.arange(len(flat) + 1))
            pick = pa.array(lo + owner)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(num + owner), batch.column("doc").take(pick), batch.column("row").take(pick), pa.array(here - begin, pa.int32()),
                    pa.array([xxhash.xxh3_128_digest(x) for x in flat], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(runs[:, 1] - runs[:, 0], pa.int32())),
                ],
                ["num", "doc", "row", "i", "line", "runs"],
            )
            num += hi - lo


def _choose(batches, bits, flagged):
    for batch in batches:
        keep = passes(bits.value, take(batch, "slot"))
        yield batch.filter(pa.array(keep if flagged else ~keep))


@releasing
def _unchanged(batches, text, width, bits):
    for batch in _choose(batches, bits, False):
        n_lines = [sum(1 for line in t.split("\n") if line.strip()) for _, _, texts in text_parts(batch, text, 1 << 20) for t in texts]
        columns = [*batch.columns[:width], pa.array(n_lines, pa.int32()), pa.array([0] * len(n_lines), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:width], "n_lines", "n_deleted"])


@releasing
def _delete(batches, text, width):
    """The rows without the lines of their spans, or, for later copies of a row, without any."""
    for batch in batches:
        texts, n_lines, n_deleted = [], [], []
        for value, spans, later in zip(*(batch.column(k).to_pylist() for k in (text, width, width + 1)), strict=True):
            lines = (value or "").split("\n")
            real = [i for i, line in enumerate(lines) if line.strip()]
            gone = set(range(len(real))) if later else {i for s in spans or () for i in range(s["i"], s["i"] + s["n"])}
            if gone:
                out = {real[i] for i in gone}
                value = "\n".join(line for i, line in enumerate(lines) if i not in out)
            texts.append(value)
            n_lines.append(len(real))
            n_deleted.append(len(gone))
        columns = list(batch.columns[:width])
        columns[text] = pa.array(texts, pa.string())
        names = [*batch.schema.names[:width], "n_lines", "n_deleted"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int32()), pa.array(n_deleted, pa.int32())], names)
