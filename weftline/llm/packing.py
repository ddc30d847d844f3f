"""Best-fit packing under conflicts (operator 7)."""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import partitions, releasing, starts_of, take, whole_groups
from weftline.plans.stages import Stages

#: Documents of a shard, on average; rows of one id that stay in one shard.
SHARD, REPEATS = 4096, 8


def word_count(text: Column) -> Column:
    """Words that ASCII white space separates."""
    return F.regexp_count(text, F.lit(r"\S+"))


def same_text(text: Column) -> Column:
    """Equal for texts that differ at most in case and white space."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))))


def best_fit_pack(
    docs: DataFrame, *, capacity=2048, length: Column | None = None, cluster: Column | None = None,
    id_col="doc_id", text_col="text", source_col="source",
) -> DataFrame:
    """(doc_id, piece, start, length, bin, position): where each piece of each document goes.

    A bin holds at most ``capacity`` units, and never two pieces of one source or
    of one duplicate cluster. ``length`` measures a document (its words, unless
    given) and ``cluster`` names its duplicates (texts that differ in case and
    white space at most, unless given). A document longer than a bin is cut into
    full pieces, which fill bins of their own, and a rest. A document of length 0
    has one piece of length 0.

    Documents are dealt by a hash of their id into shards of about SHARD, which
    are packed on their own; a hot source or cluster is dealt evenly, and so are
    the rows of an id that has more than a few. A shard
    takes its pieces longest first. Its open bins are sorted by what is left in
    them, and carry bitmaps of their sources and clusters; the search starts at
    the tightest bin that a piece fits and goes on to the next larger until the
    bitmaps agree, or opens a bin. Full bins leave the list.

    bin is unique over all shards: shard * 2^32 + number. A null source is a
    source that conflicts with nothing; a null text has length 0; a null id is
    dealt by its text; repeated rows are documents of their own, of one cluster.
    A very long text is measured as it streams by; only lengths are shuffled.
    Further columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    text = F.col(text_col)
    rows = docs.select(
        F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), text)).alias("key"),
        F.monotonically_increasing_id().alias("number"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.greatest(F.coalesce((word_count(text) if length is None else length).cast("long"), F.lit(0)), F.lit(0)).alias("length"),
        F.xxhash64(F.col(source_col)).alias("source"),
        F.col(source_col).isNotNull().alias("sourced"),
        F.coalesce(same_text(text) if cluster is None else cluster.cast("long"), F.lit(0)).alias("cluster"),
    )
    rows = stages.write(rows)  # a few numbers a document; written, so that the row numbers hold
    shards = max(1, -(-rows.count() // SHARD))
    many = stages.write(rows.groupBy("key").agg(F.count("*").alias("times")).where(f"times > {REPEATS}").select("key", F.lit(True).alias("often")))
    own = F.xxhash64("key", F.when(F.col("often"), F.col("number")))
    rows = rows.join(many, "key", "left").withColumn("shard", F.pmod(own, F.lit(shards))).drop("key", "number", "often")
    dealt = rows.repartition(min(shards, max(partitions(spark), 1)), "shard").sortWithinPartitions(
        "shard", F.desc("length"), "doc_id", "cluster", "source"
    )
    return dealt.mapInArrow(
        partial(_pack, capacity=capacity), "doc_id long, piece int, start long, length long, bin long, position int"
    )


class Bins:
    """The bins of a shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[tuple[int, int]] = []  # (left, bin), sorted
        self.sources: list[int] = []  # bitmaps
        self.clusters: list[int] = []
        self.held: list[int] = []

    def put(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, place in it) for a piece; source and cluster are single bits, or 0 where nothing conflicts."""
        at = bisect_left(self.open, (length, -1))
        while at < len(self.open):
            left, b = self.open[at]
            if not (self.sources[b] & source or self.clusters[b] & cluster):
                del self.open[at]
                break
            at += 1  # the next tightest
        else:
            left, b = self.capacity, len(self.held)
            self.sources.append(0)
            self.clusters.append(0)
            self.held.append(0)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.held[b] += 1
        if left > length:
            insort(self.open, (left - length, b))
        return b, self.held[b] - 1


def pack_shard(lengths, sources, clusters, capacity: int):
    """(row, piece, start, length, bin, position) of all pieces; sources and clusters are bits.

    Full pieces come first, then the rests, longest first, with ties in the order of rows.
    """
    bins, out, rests = Bins(capacity), [], []
    for row, length in enumerate(lengths):
        full = length // capacity if length > capacity else 0
        if full and length == full * capacity:
            full -= 1
        for piece in range(full):
            out.append((row, piece, piece * capacity, capacity, *bins.put(capacity, 0, 0)))
        rests.append((full * capacity - length, row, full))
    for minus, row, piece in sorted(rests):
        place = bins.put(-minus, sources[row], clusters[row])
        out.append((row, piece, piece * capacity, -minus, *place))
    return out


def _bits(values: np.ndarray) -> list[int]:
    """A bit for each value that occurs more than once; 0 for those that cannot conflict."""
    _, back, times = np.unique(values, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    return [1 << int(place[i]) if times[i] > 1 else 0 for i in back]


@releasing
def _pack(batches, capacity):
    for table in whole_groups(batches, "shard"):
        shard, ids, length, cluster = (take(table, c) for c in ("shard", "doc_id", "length", "cluster"))
        valid = np.asarray(table.column("doc_id").is_valid())
        source = np.where(take(table, "sourced"), take(table, "source"), np.arange(len(shard)) + (1 << 62))
        starts = starts_of(shard)
        for a, b in zip(starts, starts[1:], strict=False):
            found = pack_shard(length[a:b].tolist(), _bits(source[a:b]), _bits(cluster[a:b]), capacity)
            row, piece, start, size, bin_, place = (np.array(c, np.int64) for c in zip(*found, strict=True))
            columns = [
                pa.array(ids[a:b][row], pa.int64(), mask=~valid[a:b][row]), pa.array(piece, pa.int32()), pa.array(start), pa.array(size),
                pa.array((int(shard[a]) << 32) + bin_), pa.array(place, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "bin", "position"])
