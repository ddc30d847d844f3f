"""N-gram Jaccard join with Bayesian pruning of candidates (operator 1)."""

from __future__ import annotations

from functools import lru_cache, partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import (
    WordHashes, components, forest, gram_hashes, mix, pack, partitions, passes, releasing, slot_filter, slot_of, starts_of, take, text_parts, unpack, whole_groups,
)
from weftline.plans.stages import Stages

#: MinHash values; the chance with which banding may miss a pair at the threshold; classes of one bucket in a task.
HASHES, MISS, BLOCK = 128, 1e-6, 256
#: Values of a tile's sets that are compared at a time, on average.
SHARE = 1 << 19
#: MinHash values after which a pair is judged again.
STEPS = (16, 32, 64, 128)
_FACTORS = np.random.default_rng(1).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def banding(threshold: float) -> tuple[int, int]:
    """(bands, values of a band): the longest bands of which a pair at the threshold shares none with a chance of MISS at most."""
    for values in range(HASHES, 0, -1):
        bands = HASHES // values
        if (1 - threshold**values) ** bands <= MISS:
            return bands, values
    raise ValueError(f"{HASHES} MinHash values can't find pairs at a similarity of {threshold}")


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each of STEPS, the fewest matches that keep a pair.

    With a uniform prior, m matches of n leave the posterior Beta(m+1, n-m+1) of
    the similarity, which exceeds t with the probability that of n+1 trials with
    chance t at most m succeed. Pairs for which this is below ``tolerance`` go.
    """
    out = []
    for n in STEPS:
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out.append(m)
    return tuple(out)


def jaccard_join(
    docs: DataFrame, *, threshold=0.8, words=5, tolerance=1e-6, id_col="doc_id", text_col="text"
) -> DataFrame:
    """(doc_id, class_id, n_links, kept): one row per document.

    Documents link if the sets of their shingles (``words`` lower-cased words
    that white space separates; a shorter text is one shingle) have a Jaccard
    similarity of at least ``threshold``. n_links counts the other documents
    that link with one directly, class_id is the smallest doc_id that links
    reach, and kept says that it is the document's own.

    1. Documents with equal sets are one class; from here on classes are compared.
    2. Classes that agree in a band of MinHash values are candidates. The length of
       bands follows from the threshold (see ``banding``): at 0.8, 32 bands of 4
       miss a pair with probability 5e-8. Buckets of one class go first, by keys
       alone.
    3. In a bucket, pairs compare their values step by step and are dropped once
       the posterior probability of reaching the threshold is below
       ``tolerance``. A pair that several buckets hold belongs to its first band.
       A large bucket is dealt out in pairs of blocks.
    4. What is left is verified exactly on the shingles (64-bit hashes), which
       are read again for these documents only. Tasks return counts and a
       spanning forest in place of pairs.

    A text without words (null, empty, white space) has no shingles and links
    with nothing. A row without a doc_id takes no part: class_id null, n_links 0,
    kept. Repeated rows are documents of their own that link with each other;
    rows that share an id share a class. Whole texts count, however long: a task
    holds the shingles of one at a time. Further columns are ignored. An empty
    table gives an empty result. Thresholds that 128 MinHash values can't serve
    (about 0.1 and less) raise.
    """
    n_bands, values = banding(threshold)
    spark = docs.sparkSession
    stages = Stages(spark)
    width = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = rows.where("doc_id is not null")

    signed = stages.write(known.mapInArrow(partial(_signatures, words=words), "doc_id long, cls binary, sig binary"))
    classes = stages.write(
        signed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig"))
    )
    start = F.col("band") * 4 * values + 1
    bands = classes.select("cls", "sig", F.explode(F.sequence(F.lit(0), F.lit(n_bands - 1))).alias("band")).select(
        "cls", "band", F.xxhash64("band", F.substring("sig", start, F.lit(4 * values))).alias("bucket")
    )
    # staged before they are joined, so that adaptive execution can split a bucket with many classes
    full = stages.write(bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    met = bands.join(full, "bucket").withColumns({"mine": F.pmod(F.xxhash64("cls"), blocks), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    met = met.select(
        "cls", "band", "mine", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"),
        (F.col("mine") == F.col("other")).alias("same"),
    )
    tiles = met.join(classes, "cls").repartition(width, "tile").sortWithinPartitions("tile", "cls")
    kept = stages.write(
        tiles.mapInArrow(
            partial(_prune, least=least_matches(threshold, tolerance), bands=n_bands, values=values), "tile long, cls binary, rep long, n long, pos int, partners binary"
        )
    )

    bits = spark.sparkContext.broadcast(slot_filter(kept.select(slot_of("rep"))))
    again = known.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(len(bits.value) * 8)))
    shingles = again.mapInArrow(partial(_shingle_rows, words=words, bits=bits), "cls binary, shingles binary")
    shingles = shingles.groupBy("cls").agg(F.first("shingles").alias("shingles"))
    verify = kept.join(shingles, "cls").repartition(width, "tile").sortWithinPartitions("tile", "pos")
    links = stages.write(verify.mapInArrow(partial(_verify, threshold=threshold), "cls binary, rep long, links long, root long"))

    part = components(stages, links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("cls").agg(F.sum("links").alias("links"))
    found = classes.select("cls", "rep", "n").join(counted, "cls", "left").join(part, F.col("rep") == F.col("node"), "left")
    found = found.select("cls", F.coalesce("component", "rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = stages.write(found)  # so that adaptive execution can split a class of many copies
    some = signed.where("cls is not null").select("doc_id", "cls").join(found, "cls").select("doc_id", "class_id", "n_links")
    none = signed.where("cls is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    idle = rows.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    out = some.unionByName(none).unionByName(idle)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def shingle_sets(texts: list[str], words: int, cache: WordHashes) -> list[np.ndarray]:
    """Sorted different shingles of each text."""
    hashes, offsets = cache.of(texts)
    grams = gram_hashes(hashes, words)
    out = []
    for a, b in zip(offsets, offsets[1:], strict=False):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        else:
            out.append(gram_hashes(hashes[a:b], b - a) if b > a else hashes[:0])
    return out


def _class(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return np.array([mix(s).sum(), mix(s + np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s))], np.uint64).tobytes()


def _minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES values for each of the sets, none of which is empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, held = lo, 0
        while hi < len(sets) and (hi == lo or held + len(sets[hi]) < 16_384):  # stays in the processor's cache
            held += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        at = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        for k, factor in enumerate(_FACTORS):
            out[lo:hi, k] = np.minimum.reduceat((flat * factor) >> np.uint64(32), at)
        lo = hi
    return out


@releasing
def _signatures(batches, words):
    cache = WordHashes()
    for batch in batches:
        for lo, hi, texts in text_parts(batch, "text", 1 << 20):
            sets = shingle_sets(texts, words, cache)
            some = [s for s in sets if len(s)]
            values = iter(_minhashes(some))
            rows = [(_class(s), next(values).tobytes()) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], ["doc_id", "cls", "sig"]
            )


def _pairs(tiles: np.ndarray, mine: np.ndarray, same: np.ndarray):
    """Index pairs within tiles, in arrays of bounded size: all of one block, or those across two."""
    starts = starts_of(tiles)
    sizes = np.diff(starts)
    small = np.repeat(sizes <= 24, sizes)
    for step in range(1, int(sizes[sizes <= 24].max(initial=1))):
        a = np.flatnonzero(small[:-step] & small[step:] & (tiles[step:] == tiles[:-step]))
        a = a[same[a] | (mine[a] != mine[a + step])]
        if len(a):
            yield a, a + step
    for s, n in zip(starts[:-1][sizes > 24], sizes[sizes > 24], strict=True):
        if same[s]:
            a, b = np.triu_indices(n, 1)
        else:
            side = mine[s : s + n] == mine[s]
            a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(side), np.flatnonzero(~side), indexing="ij"))
        for lo in range(0, len(a), 1 << 16):
            yield s + a[lo : lo + (1 << 16)], s + b[lo : lo + (1 << 16)]


@releasing
def _prune(batches, least, bands, values):
    """Of each tile, the classes that are left with partners, as positions among these classes."""
    for table in whole_groups(batches, "tile"):
        tiles, mine, same, band = (take(table, c) for c in ("tile", "mine", "same", "band"))
        data = table.column("sig").to_pylist()
        sig = np.frombuffer(b"".join(data), np.uint32).reshape(len(data), HASHES)
        left, right = [], []
        for a, b in _pairs(tiles, mine, same):
            matches, at = np.zeros(len(a), np.int64), 0
            for step, enough in zip(STEPS, least, strict=True):
                matches += (sig[a, at:step] == sig[b, at:step]).sum(1)
                stay = matches >= enough
                a, b, matches, at = a[stay], b[stay], matches[stay], step
                if not len(a):
                    break
            if len(a):
                first = (sig[a, : bands * values] == sig[b, : bands * values]).reshape(-1, bands, values).all(2).argmax(1)
                own = first == band[a]
                left.append(a[own])
                right.append(b[own])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        if not len(a):
            continue
        rows = np.unique(np.concatenate([a, b]))
        starts = starts_of(tiles[rows])
        pos = np.arange(len(rows)) - np.repeat(starts[:-1], np.diff(starts))
        order = np.argsort(a, kind="stable")
        partner = pos[np.searchsorted(rows, b[order])].astype(np.uint16)
        ends = np.searchsorted(a[order], rows, side="right")
        parts = [_listed(partner[x:y]) for x, y in zip(np.searchsorted(a[order], rows), ends, strict=True)]
        out = table.select(["tile", "cls", "rep", "n"]).take(pa.array(rows)).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [*(c.chunk(0) for c in out.columns), pa.array(pos, pa.int32()), pa.array(parts, pa.binary())],
            ["tile", "cls", "rep", "n", "pos", "partners"],
        )


def _listed(places: np.ndarray) -> bytes:
    """Places of partners as a list, or as a bitmap where that is shorter: a tile has a bounded number of classes."""
    bits = np.zeros(int(places.max(initial=0)) + 1, np.uint8)
    bits[places] = 1
    bits = np.packbits(bits).tobytes()
    return b"L" + places.tobytes() if 2 * len(places) <= len(bits) else b"B" + bits


def _places(data: bytes) -> np.ndarray:
    if data[:1] == b"L":
        return np.frombuffer(data, np.uint16, offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)))


@releasing
def _shingle_rows(batches, words, bits):
    cache = WordHashes()
    for batch in batches:
        batch = batch.filter(pa.array(passes(bits.value, take(batch, "slot"))))
        for _, _, texts in text_parts(batch, "text", 1 << 20):
            sets = [s for s in shingle_sets(texts, words, cache) if len(s)]
            found = {_class(s): s for s in sets}
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), pa.array([pack(s.tobytes()) for s in found.values()], pa.binary())], ["cls", "shingles"]
            )


def _add_shared(sets: list[np.ndarray], total: np.ndarray) -> None:
    """Adds to ``total`` how many values each two of the sets share."""
    values, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    shared = times[back] > 1  # a value of one set is in no intersection
    column = (np.cumsum(times > 1) - 1)[back[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, [lo, lo + width])
        present = np.zeros((len(sets), width), np.float32)
        present[owner[x:y], column[x:y] - lo] = 1
        total += present @ present.T


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values sets[a] and sets[b], which are sorted, share, for many pairs of few sets: by ranges of values, so that memory is bounded."""
    if len(a) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    total = np.zeros((len(sets), len(sets)), np.float32)
    parts = max(1, -(-sum(map(len, sets)) // SHARE))
    edges = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(s, edges), [len(s)]]) for s in sets]
    for p in range(parts):
        _add_shared([s[c[p] : c[p + 1]] for s, c in zip(sets, cuts, strict=True)], total)
    return total[a, b].astype(np.int64)


@releasing
def _verify(batches, threshold):
    for table in whole_groups(batches, "tile"):
        tiles, rep, n = (take(table, c) for c in ("tile", "rep", "n"))
        cls, partners, data = table.column("cls").to_pylist(), table.column("partners").to_pylist(), table.column("shingles")
        starts = starts_of(tiles)
        out = []
        for s, e in zip(starts, starts[1:], strict=False):
            others = [_places(p) for p in partners[s:e]]
            a = np.repeat(np.arange(e - s), list(map(len, others)))
            b = np.concatenate(others)
            sets = [np.frombuffer(unpack(x), np.uint64) for x in data.slice(s, e - s).to_pylist()]  # of one tile at a time
            sizes = np.array(list(map(len, sets)))
            both = intersections(sets, a, b)
            link = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
            a, b = a[link], b[link]
            if not len(a):
                continue
            own, times = rep[s:e], n[s:e]
            links = np.bincount(a, times[b], minlength=e - s) + np.bincount(b, times[a], minlength=e - s)
            ids = np.unique(own)
            root = ids[forest(np.searchsorted(ids, own[a]), np.searchsorted(ids, own[b]), len(ids))]
            for i in np.flatnonzero(links):
                out.append((cls[s + i], own[i], int(links[i]), root[np.searchsorted(ids, own[i])]))
        if out:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "rep", "links", "root"])
