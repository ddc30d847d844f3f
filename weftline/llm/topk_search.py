"""Exact top-k search by a pivot-distance index (operator 10)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import partitions, releasing, starts_of, take, whole_groups
from weftline.llm.vectors import by_length, distances, fitted, k_means, sample_vectors
from weftline.plans.stages import Stages

#: Vectors that pivots are fitted on; vectors for each pivot squared and most pivots; vectors of an annulus, least and most annuli of a pivot.
SAMPLE, PER_PIVOT, PIVOTS, PER_RING, LEAST_RINGS, RINGS = 4096, 64, 256, 512, 4, 63
#: Vectors and queries of a tile; shares of the annuli after which the bar is raised.
BLOCK, QUERIES, WAVES = 8192, 2048, (1 / 16, 1 / 4, 1)
_NONE, _MOST, _LEAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max, np.finfo(np.float64).min
#: Components from here on take the slow way; the annulus of their vectors, which has no bound.
HUGE, FAR = 1 << 31, 63
_TOP = "query_id long, top array<struct<score:long,vec_id:long>>, seen long"


@dataclass
class Annuli:
    """Pivots and, for each annulus: its pivot and number, least and greatest distance, greatest squared norm."""

    pivots: np.ndarray
    edges: list[np.ndarray]  # of each pivot: inner ends of its annuli but the first
    pivot: np.ndarray | None = None
    ring: np.ndarray | None = None
    inner: np.ndarray | None = None
    outer: np.ndarray | None = None
    norm2: np.ndarray | None = None

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest pivot, annulus, distance to the pivot)."""
        d = distances(x, self.pivots)
        near = d.argmin(1)
        least = d[np.arange(len(x)), near]
        ring = np.empty(len(x), np.int64)
        for p in np.unique(near):
            own = near == p
            ring[own] = np.searchsorted(self.edges[p], least[own], side="right")
        return near, ring, least

    def bounds(self, q: np.ndarray, q2: np.ndarray) -> np.ndarray:
        """The greatest inner product that each query, with squared norm q2, can have with a vector of each annulus.

        A vector of the annulus is at least as far from the query as the triangle
        inequality says, and its norm is bounded: 2 <q, x> = |q|^2 + |x|^2 - |q - x|^2.
        """
        d = distances(q, self.pivots)[:, self.pivot]
        apart = np.maximum(0, np.maximum(d - self.outer, self.inner - d) - 1e-9 * (d + self.outer))
        q2 = q2[:, None]
        free = (q2 + self.norm2 - apart**2) / 2
        norms = np.sqrt(q2) * np.sqrt(np.where(self.ring == FAR, 0, self.norm2))  # and no more than the product of the norms
        bound = np.minimum(free, norms) * (1 + 1e-9) + 1e-3
        return np.where(self.ring == FAR, np.inf, bound)


def top_k(
    rows: DataFrame, *, k=20, scale=64, is_query: Column | None = None, id_col="vec_id", vector_col="embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k greatest inner products, ties to smaller ids.

    Vectors are turned into floor(scale * x), so scores are exact integers.
    Every row is indexed under its nearest pivot and its distance to it; the
    distances of a pivot are cut into annuli, in tables of every size. A query
    first searches the annulus it lies in, then the others in the order of their
    bounds (see ``Annuli.bounds``), in WAVES: after each the bar is raised to its
    k-th score so far, and annuli whose bound is below it are never visited. A
    query goes to a pivot once in a wave, with a bit for each annulus to visit.
    Pivots with many vectors, or many visits, are dealt out in blocks, and each
    block returns k rows a query at most. Pivots are fitted on a sample of about
    SAMPLE different vectors, and at most PIVOTS * (RINGS + 1) annuli are
    described to the tasks.

    ``is_query`` is an expression over vec_id. Candidates are the rows with
    another id than the query's and as many components. Vectors that are null,
    empty or that hold null or non-finite components take no part, nor do rows
    with a null id. Those of another length than most of the sample are indexed
    by as many components as the pivots have. Vectors with huge components are
    met by every query, in integers of any size; a score beyond 64 bits becomes
    the least or greatest long. A query whose row is repeated is answered once; a
    repeated candidate is met as often as it occurs. Fewer than k candidates give
    fewer rows; an empty table gives an empty result. Further columns are
    ignored.
    """
    waves = search_waves(rows, k=k, scale=scale, is_query=is_query, id_col=id_col, vector_col=vector_col)
    return _best(waves[-1], k).select("query_id", F.posexplode("top").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score")
    )


def visited_share(rows: DataFrame, **options) -> float:
    """What share of all pairs of a query and a row the search compares."""
    waves = search_waves(rows, **options)
    found = waves[-1].agg(F.sum("seen"), F.count_distinct("query_id")).first()
    return found[0] / (found[1] * rows.count()) if found[1] else 0.0


def search_waves(rows: DataFrame, *, k=20, scale=64, is_query: Column | None = None, id_col="vec_id", vector_col="embedding") -> list[DataFrame]:
    """After each wave, the (query_id, top, seen) that the tiles returned so far."""
    spark = rows.sparkSession
    stages = Stages(spark)
    source = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")).where("vec_id is not null")
    is_query = F.pmod("vec_id", F.lit(20)) == 0 if is_query is None else is_query

    found, different = sample_vectors(source, "x", SAMPLE)
    found = np.clip(np.floor(np.clip(found, -1e300, 1e300) * scale), -HUGE, HUGE) if len(found) else np.zeros((1, 0))
    pivots = k_means(found, min(PIVOTS, max(1, round((different / PER_PIVOT) ** 0.5))))
    index = Annuli(pivots, [np.zeros(0)] * len(pivots))
    layout = "vec_id long, data binary, pivot int, ring int, d double, norm2 double"
    near = stages.write(source.mapInArrow(partial(_place, index=spark.sparkContext.broadcast(index), scale=scale), layout))
    rings = min(RINGS, max(LEAST_RINGS, different // (len(pivots) * PER_RING)))
    cuts = [i / rings for i in range(1, rings)]
    for row in near.where(F.col("ring") != FAR).groupBy("pivot").agg(F.percentile_approx("d", cuts, 1000).alias("cuts")).collect():  # a row for each pivot
        index.edges[row.pivot] = np.unique(row.cuts)
    edges = spark.sparkContext.broadcast(index.edges)
    placed = stages.write(near.mapInArrow(partial(_rings, edges=edges), layout))
    stages.drop(near)
    facts = (
        placed.groupBy("pivot", "ring")
        .agg(F.min("d").alias("inner"), F.max("d").alias("outer"), F.max("norm2").alias("norm2"), F.count("*").alias("n"))
        .orderBy("pivot", "ring")
        .collect()
    )  # a row for each annulus
    index.pivot, index.ring, index.inner, index.outer, index.norm2 = (
        np.array([r[i] for r in facts], np.int64 if i < 2 else np.float64) for i in range(5)
    )
    sizes: dict[int, int] = {}
    for r in facts:
        sizes[r.pivot] = sizes.get(r.pivot, 0) + r.n
    blocks = spark.createDataFrame([(p, -(-n // BLOCK)) for p, n in sizes.items()], "pivot int, blocks long")
    held = spark.sparkContext.broadcast(index)

    queries = placed.where(is_query).groupBy("vec_id").agg(F.first(F.struct("data", "pivot", "ring", "norm2")).alias("q"))
    queries = stages.write(queries.select("vec_id", "q.*"))
    own = queries.select("vec_id", "data", "pivot", F.expr("shiftleft(1L, ring)").alias("mask"), F.lit(_NONE).alias("bar"))
    waves = [_search(stages, placed, blocks, k, scale, own)]
    done = 0.0
    for share in WAVES:
        bars = _best(waves[-1], k).select(
            F.col("query_id").alias("vec_id"), F.when(F.size("top") >= k, -F.element_at("top", -1)["minus"]).otherwise(_NONE).alias("reached")
        )
        known = queries.join(bars, "vec_id", "left").select("vec_id", "data", "pivot", "ring", "norm2", F.coalesce("reached", F.lit(_NONE)).alias("bar"))
        visits = known.mapInArrow(partial(_expand, index=held, done=done, share=share), "vec_id long, data binary, pivot int, mask long, bar long")
        waves.append(waves[-1].unionByName(_search(stages, placed, blocks, k, scale, stages.write(visits))))
        done = share
    return waves


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, top): the k best of what the tiles returned, in order."""
    best = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
    tops = found.select(
        "query_id",
        F.transform("top", lambda t: F.struct((-t["score"]).alias("minus"), t["vec_id"].alias("vec_id"))).alias("top"),
        F.pmod(F.xxhash64("top"), F.lit(8)).alias("share"),
    )
    return tops.groupBy("query_id", "share").agg(best).groupBy("query_id").agg(best)


def _search(stages: Stages, placed: DataFrame, blocks: DataFrame, k: int, scale: int, visits: DataFrame) -> DataFrame:
    """The k best of every (query, block of a pivot) that the visits name."""
    asked = visits.groupBy("pivot").agg(F.ceil(F.count("*") / QUERIES).alias("shares"))
    sizes = F.broadcast(blocks.join(F.broadcast(asked), "pivot"))  # a row for each pivot
    tile = F.xxhash64("pivot", "block", "share").alias("tile")
    members = placed.join(sizes, "pivot").select(
        "pivot", "vec_id", "data", F.lit(_NONE).alias("bar"), F.lit(0).alias("kind"), F.col("ring").cast("long").alias("mask"),
        F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks").alias("block"), F.expr("explode(sequence(0L, shares - 1))").alias("share"),
    )
    asking = visits.join(sizes, "pivot").select(
        "pivot", "vec_id", "data", "bar", F.lit(1).alias("kind"), "mask",
        F.expr("explode(sequence(0L, blocks - 1))").alias("block"), F.pmod(F.xxhash64("vec_id", F.lit(2)), "shares").alias("share"),
    )
    rows = members.unionByName(asking).select("vec_id", "data", "bar", "kind", "mask", "pivot", tile)
    dealt = rows.repartition(partitions(stages.spark), "tile").sortWithinPartitions("tile", "kind", "mask", "vec_id")
    return stages.write(dealt.mapInArrow(partial(_compare, k=k, scale=scale), _TOP))


def _coded(x: np.ndarray, scale) -> list[bytes]:
    """floor(scale * x) in as few bytes as hold it, after a letter that says how many; raw doubles where it is huge."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    most = np.abs(v).max(axis=1)
    return [
        b"h" + row.astype("<i2").tobytes() if m < 1 << 15 else b"i" + row.astype("<i4").tobytes() if m < HUGE else b"d" + raw.tobytes()
        for row, raw, m in zip(v, x, most, strict=True)
    ]


_KINDS = {b"h": "<i2", b"i": "<i4", b"d": "<f8"}


def _decoded(data: list[bytes]) -> np.ndarray:
    """The integers of vectors of one length, none of them huge, as doubles."""
    if len({v[:1] for v in data}) == 1:
        return np.frombuffer(b"".join(v[1:] for v in data), _KINDS[data[0][:1]]).reshape(len(data), -1).astype(np.float64)
    return np.array([np.frombuffer(v, _KINDS[v[:1]], offset=1) for v in data], np.float64)


@releasing
def _place(batches, index, scale):
    index = index.value
    dim = index.pivots.shape[1]
    for batch in batches:
        for lo in range(0, batch.num_rows, 4000):
            part = batch.slice(lo, 4000)
            for rows, x in by_length(part.column("x")):
                if not len(rows):
                    continue
                data = _coded(x, scale)
                huge = np.array([v[:1] == b"d" for v in data])
                v = np.where(huge[:, None], 0, np.floor(np.where(huge[:, None], 0, x) * scale))
                pivot, ring, d = index.place(fitted(v, dim))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(rows)), pa.array(data, pa.binary()), pa.array(pivot, pa.int32()),
                        pa.array(np.where(huge, FAR, ring), pa.int32()), pa.array(d), pa.array(np.where(huge, np.inf, (v * v).sum(1))),
                    ],
                    ["vec_id", "data", "pivot", "ring", "d", "norm2"],
                )


@releasing
def _rings(batches, edges):
    """The annuli of vectors whose pivots are known."""
    for batch in batches:
        pivot, ring, d = (take(batch, c) for c in ("pivot", "ring", "d"))
        ring = ring.copy()
        for p in np.unique(pivot):
            own = (pivot == p) & (ring != FAR)
            ring[own] = np.searchsorted(edges.value[p], d[own], side="right")
        yield batch.set_column(batch.schema.get_field_index("ring"), "ring", pa.array(ring, pa.int32()))


@releasing
def _expand(batches, index, done, share):
    """The annuli from one share of them to the next, in the order of their bounds, in which a score as good as the bar can be."""
    index = index.value
    dim, n = index.pivots.shape[1], len(index.ring)
    lo_at, hi_at = 1 + int(done * (n - 1)), 1 + int(share * (n - 1))  # the first is the query's own
    step = max(1, (1 << 20) // max(1, n))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            data, norm2 = part.column("data").to_pylist(), take(part, "norm2")
            q = np.array([np.zeros(dim) if v[:1] == b"d" else fitted(_decoded([v]), dim)[0] for v in data])
            bound = index.bounds(q, np.where(np.isfinite(norm2), norm2, 0))
            bound[~np.isfinite(norm2)] = np.inf
            own = (index.pivot == take(part, "pivot")[:, None]) & (index.ring == take(part, "ring")[:, None])
            order = np.argsort(np.where(own, -np.inf, np.maximum(-bound, _LEAST)), axis=1, kind="stable")[:, lo_at:hi_at]
            row, at = np.nonzero(np.take_along_axis(bound, order, 1) >= take(part, "bar").astype(np.float64)[:, None])
            if not len(row):
                continue
            annulus = order[row, at]
            key = row * len(index.pivots) + index.pivot[annulus]
            by = np.argsort(key, kind="stable")
            starts = starts_of(key[by])
            mask = np.bitwise_or.reduceat(np.int64(1) << index.ring[annulus[by]], starts[:-1])
            out = part.take(pa.array(key[by][starts[:-1]] // len(index.pivots)))
            yield pa.RecordBatch.from_arrays(
                [out.column("vec_id"), out.column("data"), pa.array(key[by][starts[:-1]] % len(index.pivots), pa.int32()), pa.array(mask), out.column("bar")],
                ["vec_id", "data", "pivot", "mask", "bar"],
            )


def _products(q: list[bytes], x: list[bytes], scale: int) -> np.ndarray:
    """Exact inner products of vectors of one length: doubles hold them unless components are huge."""
    if not any(v[:1] == b"d" for v in (*q, *x)):
        a, b = _decoded(q), _decoded(x)
        if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
            return (a @ b.T).astype(np.int64)
    a, b = ([_integers(v, scale) for v in side] for side in (q, x))
    wide = [[sum(map(int.__mul__, v, w)) for w in b] for v in a]
    return np.array([[min(max(s, _NONE + 1), _MOST) for s in v] for v in wide], np.int64)


def _integers(data: bytes, scale: int) -> list[int]:
    values = np.frombuffer(data, _KINDS[data[:1]], offset=1).tolist()
    if data[:1] != b"d":
        return values
    return [floor(v * scale) if abs(v) < 1e300 else int(v) * int(scale) for v in values]


@releasing
def _compare(batches, k, scale):
    for table in whole_groups(batches, "tile"):
        tiles, kind, ids, bar, mask, pivot = (take(table, c) for c in ("tile", "kind", "vec_id", "bar", "mask", "pivot"))
        data = table.column("data").to_pylist()
        sizes = np.array([(len(v) - 1) // np.dtype(_KINDS[v[:1]]).itemsize for v in data])
        huge = np.array([v[:1] == b"d" for v in data])
        starts = starts_of(tiles)
        names, tops, seen = [], [], []
        for a, b in zip(starts, starts[1:], strict=False):
            m = a + int(np.searchsorted(kind[a:b], 1))
            for n in np.unique(sizes[a:b]):
                members, asking = (r[sizes[r] == n] for r in (np.arange(a, m), np.arange(m, b)))
                if not len(members) or not len(asking):
                    continue
                for special in (False, True):  # the few huge vectors don't slow the others
                    own = members[huge[members] == special]
                    for lo in range(0, len(asking) if len(own) else 0, 256):
                        strip = asking[lo : lo + 256]
                        scores = _products([data[i] for i in strip], [data[i] for i in own], scale)
                        for q, row in zip(strip, scores, strict=True):
                            visited = (mask[q] >> mask[own]) & 1 == 1
                            visited &= (ids[own] != ids[q]) & (pivot[own] == pivot[q])
                            keep = np.flatnonzero(visited & (row >= bar[q]))
                            names.append(ids[q])
                            seen.append(int(visited.sum()))
                            if len(keep) > k:  # all that tie with the k-th stay for the order of ids
                                least = np.partition(row[keep], len(keep) - k)[len(keep) - k]
                                keep = keep[row[keep] >= least]
                            keep = keep[np.lexsort((ids[own][keep], -row[keep]))][:k]
                            tops.append((row[keep], ids[own][keep]))
        if names:
            ends = np.cumsum([0, *(len(s) for s, _ in tops)])
            hits = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([s for s, _ in tops])), pa.array(np.concatenate([i for _, i in tops]))], ["score", "vec_id"]
            )
            top = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), top, pa.array(seen, pa.int64())], ["query_id", "top", "seen"])
