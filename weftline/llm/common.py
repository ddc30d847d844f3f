"""What several operators share: Arrow plumbing, word hashes, bounded bitmaps, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.stages import Stages

#: Bits in the bitmap of a bounded filter: 1 MiB, whatever the table's size.
FILTER_BITS = 1 << 23


def partitions(spark: SparkSession) -> int:
    """The cluster's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns freed memory to the system: a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def releasing(make: Callable) -> Callable:
    """A generator over batches that gives memory back at its end."""

    @wraps(make)
    def run(*args, **options):
        yield from make(*args, **options)
        give_back()

    return run


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_integers(values: np.ndarray) -> bytes:
    """Integers packed byte by byte, most of which are alike."""
    return pack(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()) if len(values) else b""


def unpack_integers(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = np.frombuffer(unpack(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def text_parts(batch: pa.RecordBatch, column: str | int, most: int) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) of parts of a batch that hold about ``most`` bytes at most, or one text; null counts as empty.

    Only one part at a time is turned into Python strings.
    """
    values = batch.column(column)
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(values), 0)), dtype=np.int64)
    start = 0
    while start < len(values):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + most, side="right")))
        yield start, end, [x or "" for x in values.slice(start, end - start).to_pylist()]
        start = end


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of neighbouring rows with one key, for rows sorted by it.

    Only the last group of a batch waits for the next batch, so memory holds a
    batch and one group.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if waiting and waiting[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.Table.from_batches([*waiting, batch.slice(0, cut)])
            waiting = [batch.slice(cut)]
        else:
            waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting)


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours begin, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    most = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the lower-cased words that white space separates, and each text's offset."""
        parts, offsets = [], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            words = text.lower().split()
            parts.append(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
            offsets[i + 1] = offsets[i] + len(words)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offsets


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions wrap past their text."""
    if n == 1 or not len(words):
        return mix(words)
    h = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        h = mix(h) + words[k : len(words) - n + 1 + k]
    return mix(h)


def slot_filter(rows: DataFrame) -> bytes:
    """A bitmap with the column ``slot`` of the rows set; at most 1 MiB reaches the driver.

    It only saves work: a row that isn't wanted may share a slot and be let through.
    """
    words = rows.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for row in words.toLocalIterator():
        out[row.word] = row.bits
    return out.tobytes()


def passes(bits: bytes, slots: np.ndarray) -> np.ndarray:
    """Which slots are set."""
    table = np.frombuffer(bits, np.int64)
    return (table[slots >> 6] >> (slots & 63)) & 1 == 1


def ranked(stages: Stages, rows: DataFrame, *keys: str) -> DataFrame:
    """Rows, which the keys tell apart, with ``rank``: numbers that grow in the order of the keys, with gaps.

    Rows are dealt by range and sorted in their ranges; nothing passes through
    the driver but the bounds of the ranges.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return stages.write(dealt.withColumn("rank", F.monotonically_increasing_id()))


def slot_of(column: str):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).alias("slot")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n local nodes and links a-b: each node's smallest node of its component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def components(stages: Stages, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for edges (a long, b long).

    Rounds of the two-step star contraction: each node links its larger
    neighbours, then its smaller ones, to the smallest it knows. No step gathers
    a neighbourhood: minima are combined before the shuffle, and are staged, so
    that the joins that meet a node with many links are ones that adaptive
    execution can split. Ends when a round changes nothing.
    """
    held = stages.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        # every node towards the smallest of its neighbours and itself
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stages.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stages.write(large.unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).distinct())
        # then the smaller neighbours of each node towards the smallest of them
        least = stages.write(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stages.write(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        stages.drop(low, large, least)
        same = after.count() == held.count() and after.join(held, ["a", "b"], "left_anti").isEmpty()
        if same:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component"))
        stages.drop(held)
        held = after


def take(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    col = table.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if pa.types.is_integer(col.type) and col.null_count:
        col = pc.fill_null(col, 0)
    return col.to_numpy(zero_copy_only=False)


def free_name(docs: DataFrame, base: str) -> str:
    """A name that no column has, in whatever case."""
    used = {c.lower() for c in docs.columns}
    while base.lower() in used:
        base += "_"
    return base


def with_column(docs: DataFrame, name: str, kind: str, make, *, text_col: str) -> DataFrame:
    """``docs`` with a column that ``make()``, called once a task, computes from a list of texts; one of that name is replaced."""
    docs = docs.drop(name)
    at = docs.columns.index(text_col)

    @releasing
    def run(batches):
        compute = make()
        for batch in batches:
            parts = [compute(texts) for _, _, texts in text_parts(batch, at, 1 << 20)]
            values = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(None).cast(kind)).schema)
