"""Near-duplicate embeddings by an inverted multi-index (operator 9)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import components, forest, partitions, releasing, starts_of, take, whole_groups
from weftline.llm.vectors import by_length, distances, fitted, k_means, sample_vectors
from weftline.plans.stages import Stages

#: Vectors that the codebooks are fitted on; cells for each vector and most centres of a codebook.
SAMPLE, PER_CELL, CENTRES = 8192, 8, 512
#: Vectors of a list and of a block of it; rows that meet a block at once; slack of squared distances of unit vectors for rounding.
LIST, BLOCK, STRIP, SLACK = 512, 256, 2048, 1e-12


@dataclass
class MultiIndex:
    """Two codebooks; every pair of their centres is a cell."""

    first: np.ndarray
    second: np.ndarray

    @property
    def dim(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def halves(self, x: np.ndarray):
        cut = self.first.shape[1]
        return ((x[:, :cut], self.first), (x[:, cut:], self.second))

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The nearest cell."""
        first, second = (distances(half, centres).argmin(1) for half, centres in self.halves(x))
        return first * len(self.second) + second

    def planes(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half, how far a vector must move to come into each centre's cell: squared distance to the plane between."""
        out = []
        for half, centres in self.halves(x):
            d = distances(half, centres)
            own = d.argmin(1)
            apart = distances(centres, centres)[own]
            plane = np.maximum(d**2 - d.min(1)[:, None] ** 2 - SLACK, 0) / np.maximum(2 * apart, 1e-12)
            plane[np.arange(len(own)), own] = 0
            out.append(plane**2)
        return out

    def visits(self, x: np.ndarray, reach: float, lists: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the multi-sequence traversal, each list once.

        The centres of the two halves are two sequences, sorted by how far a
        vector must move to be in a centre's cell. Pairs are visited in the order
        of the sum of both, nearest first, and the traversal of a row ends at the
        first pair beyond ``reach``. With the greatest distance of a link as
        reach, nothing can be missed.
        """
        bounds = self.planes(x)
        order = [np.argsort(b, axis=1, kind="stable") for b in bounds]
        a, b = (np.take_along_axis(m, o, 1) for m, o in zip(bounds, order, strict=True))
        # as both sequences ascend, pairs within reach are a staircase, from which the nearest are taken first
        rows, i, j = np.nonzero(a[:, :, None] + b[:, None, :] <= reach**2)
        nearest = np.lexsort((a[rows, i] + b[rows, j], rows))
        rows, i, j = rows[nearest], i[nearest], j[nearest]
        found = order[0][rows, i] * lists + order[1][rows, j] * lists // len(self.second)
        _, first = np.unique(rows * (len(self.first) * lists) + found, return_index=True)
        first.sort()  # in the order of the traversal
        return rows[first], found[first]

    def reach_of(self, x: np.ndarray, threshold: float, recall: float) -> float:
        """How far the traversal goes: as far as a link can lie, or, for a recall below 1, as that share of the sample's links does."""
        exact = float(np.sqrt(2 - 2 * threshold)) + 1e-9
        if recall >= 1 or not len(x):
            return exact
        cells, moves = self.cell(x), []
        for lo in range(0, len(x), 512):
            part = x[lo : lo + 512]
            p, q = np.nonzero(part @ x.T >= threshold)
            p, q = p[p + lo != q], q[p + lo != q]
            first, second = self.planes(part)
            moves.append(first[p, cells[q] // len(self.second)] + second[p, cells[q] % len(self.second)])
        moves = np.concatenate(moves)
        return min(exact, float(np.sqrt(np.quantile(moves, recall))) + 1e-9) if len(moves) else exact


def near_duplicate_vectors(
    rows: DataFrame, *, threshold=0.98, recall=1.0, id_col="vec_id", vector_col="embedding", label_col="label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link if their labels and lengths are equal, their labels are not null
    and their cosine, in double precision, is at least ``threshold``. Equal
    vectors of one label are one class, which is searched once; n_links still
    counts every row. Each class visits the cells of the product grid, nearest
    first, until the target ``recall``: by default 1, for which it goes as far as
    a vector at the threshold can lie, so no link is missed. A lower target stops
    where that share of the links within the sample lies. Codebooks grow with the
    number of different vectors. The cells of one first centre are dealt out as
    few lists where these are short, and each on its own where they are long; a
    class goes once to each list with a cell that it visits. Of two lists the
    greater is visited from the lesser, so a pair is met once, and every pair met
    is verified in double precision. A list with many vectors is dealt out in
    blocks, and tasks return counts and a spanning forest in place of pairs.

    The codebooks are fitted on a sample of about SAMPLE different vectors of the
    commonest length; all rows are indexed, those of another length by as many
    components as the codebooks have, which is as exact. Vectors that are null,
    zero, empty, or that hold null or non-finite components link with nothing, as
    do rows with a null id or label: their n_links is 0 and their component is
    their own id. Rows that share an id share a component. Repeated rows are
    rows of their own. Further columns are ignored; an empty table gives an
    empty result.
    """
    spark = rows.sparkSession
    stages = Stages(spark)
    width = partitions(spark)
    source = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"), F.col(label_col).cast("string").alias("label")
    )
    found, different = sample_vectors(source.where("vec_id is not null and label is not null"), "x", SAMPLE)
    unit = _unit(found[found.any(axis=1)]) if len(found) else found
    cut = unit.shape[1] // 2 if len(unit) else 0
    centres = min(CENTRES, max(1, round((different / PER_CELL) ** 0.5)))
    index = MultiIndex(k_means(unit[:, :cut], centres), k_means(unit[:, cut:], centres)) if len(unit) else MultiIndex(np.zeros((1, 0)), np.zeros((1, 0)))
    held = spark.sparkContext.broadcast(index)

    keyed = stages.write(source.mapInArrow(partial(_cells, index=held), "vec_id long, label string, cls binary, data binary, cell int"))
    classes = stages.write(
        keyed.where("cls is not null")
        .groupBy("cls")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("data").alias("data"), F.first("cell").alias("cell"), F.first("label").alias("label"))
    )
    reach = index.reach_of(unit, threshold, recall)
    wide = len(index.second)
    lengths = classes.groupBy("label", F.expr(f"cell div {wide}")).count().agg(F.sum(F.col("count") ** 2), F.sum("count")).first()
    lists = min(wide, max(1, int(np.ceil(lengths[0] / lengths[1] / LIST)))) if lengths[1] else 1  # by the length that a class meets on average
    classes = classes.withColumn("cell", F.expr(f"cast(cell div {wide} * {lists} + cell % {wide} * {lists} div {wide} as int)"))

    sizes = stages.write(classes.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    probes = classes.select("label", "cls", "rep", "n", "data", "cell").mapInArrow(
        partial(_visits, index=held, reach=reach, lists=lists), "label string, cls binary, rep long, n long, data binary, cell int, home boolean"
    )
    mine, every = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int"), F.expr("explode(sequence(0, blocks - 1))")
    columns = ["label", "cell", "cls", "rep", "n", "data"]
    members = classes.join(sizes, ["label", "cell"]).select(*columns, F.lit(0).alias("kind"), F.lit(True).alias("home"), mine.alias("b"), every.alias("p"))
    visits = probes.join(sizes, ["label", "cell"]).select(
        *columns, F.lit(1).alias("kind"), "home", F.pmod(F.xxhash64("cls", F.lit(2)), F.col("blocks")).cast("int").alias("p"), every.alias("b")
    )
    tiles = members.unionByName(visits).withColumn("tile", F.xxhash64("label", "cell", "b", "p"))
    links = stages.write(
        tiles.repartition(width, "tile")
        .sortWithinPartitions("tile", "kind")
        .mapInArrow(partial(_verify, threshold=threshold), "cls binary, rep long, links long, root long")
    )
    part = components(stages, links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.select("cls", "rep", "n").join(counted, "cls", "left").join(part, F.col("rep") == F.col("node"), "left")
    known = stages.write(known.select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = keyed.where("cls is not null").select("vec_id", "cls").join(known, "cls")
    alone = keyed.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; no row is zero."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _units(data: list[bytes]) -> np.ndarray:
    """From the bytes of vectors of one length, after one byte that says how many bytes a component has."""
    kind = data[0][0]
    return _unit(np.frombuffer(b"".join(v[1:] for v in data), f"<f{kind}").reshape(len(data), -1))


@releasing
def _cells(batches, index):
    """Each row's class, which its label and its vector name, the vector's bytes, and its cell; null where it links with nothing."""
    index = index.value
    for batch in batches:
        n, column = batch.num_rows, batch.column("x")
        kind = np.float32 if column.type.value_type == pa.float32() else np.float64
        known = np.asarray(batch.column("vec_id").is_valid()) & np.asarray(batch.column("label").is_valid())
        label = batch.column("label").to_pylist()
        cls, data, cell = [None] * n, [None] * n, [None] * n
        for rows, x in by_length(column):
            some = known[rows] & x.any(axis=1)
            rows, x = rows[some], (x[some] + 0.0).astype(kind)  # no negative zeros
            if not len(rows):
                continue
            near = index.cell(fitted(_unit(x), index.dim))
            for row, v, c in zip(rows.tolist(), x, near.tolist(), strict=True):
                data[row] = bytes([x.itemsize]) + v.tobytes()
                cls[row] = xxhash.xxh3_128_digest(f"{x.shape[1]}:{label[row]}:".encode() + data[row])
                cell[row] = c
        made = [pa.array(cls, pa.binary()), pa.array(data, pa.binary()), pa.array(cell, pa.int32())]
        # vectors of different lengths are never compared: the length becomes a part of the label
        labels = [None if d is None else f"{len(d)}:{v}" for d, v in zip(data, label, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(labels, pa.string()), *made], ["vec_id", "label", "cls", "data", "cell"])


@releasing
def _visits(batches, index, reach, lists):
    index = index.value
    step = max(1, (1 << 21) // (len(index.first) * len(index.second)))
    for batch in batches:
        sizes = batch.column("data").to_pylist()
        order = sorted(range(len(sizes)), key=lambda k: len(sizes[k]))
        batch, sizes = batch.take(pa.array(order, pa.int64())), [len(sizes[k]) for k in order]
        cuts = starts_of(np.array(sizes))
        for a, b in zip(cuts, cuts[1:], strict=False):
            for lo in range(a, b, step):
                part = batch.slice(lo, min(b - lo, step))
                rows, cells = index.visits(fitted(_units(part.column("data").to_pylist()), index.dim), reach, lists)
                home = take(part, "cell")[rows]
                rows, cells, home = (v[cells >= home] for v in (rows, cells, home))
                out = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns[:-1], pa.array(cells, pa.int32()), pa.array(cells == home)], [*out.schema.names, "home"]
                )


@releasing
def _verify(batches, threshold):
    """Of each tile: every class that links there, the rows that it links with, and the least class it is joined to."""
    for table in whole_groups(batches, "tile"):
        tiles, kind, rep, n, cell, home = (take(table, c) for c in ("tile", "kind", "rep", "n", "cell", "home"))
        label, cls = (np.array(table.column(c).to_pylist(), object) for c in ("label", "cls"))
        data = table.column("data").to_pylist()
        starts = starts_of(tiles)
        found = []
        for a, b in zip(starts, starts[1:], strict=False):
            own = np.arange(a, b)
            for name in dict.fromkeys(label[a:b]):  # one, unless hashes of tiles collide
                same = own[label[a:b] == name]
                members, visitors = same[kind[same] == 0], same[kind[same] == 1]
                if not len(members) or not len(visitors):
                    continue
                x = _units([data[k] for k in members])
                for lo in range(0, len(visitors), STRIP):
                    strip = visitors[lo : lo + STRIP]
                    p, q = np.nonzero(_units([data[k] for k in strip]) @ x.T >= threshold)
                    p, q = strip[p], members[q]
                    own_pair = (cell[p] == cell[q]) & (~home[p] | (cls[p] < cls[q]))
                    if own_pair.any():
                        found.append(_linked(p[own_pair], q[own_pair], cls, rep, n))
        if found:
            cls_, *rest = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cls_.tolist(), pa.binary()), *(pa.array(c, pa.int64()) for c in rest)], ["cls", "rep", "links", "root"])


def _linked(a, b, cls, rep, n):
    """For links between rows a and b: (class, its id, rows that it links with, least id of what it is joined to)."""
    both = np.concatenate([a, b])
    ids = np.unique(rep[both])
    root = ids[forest(np.searchsorted(ids, rep[a]), np.searchsorted(ids, rep[b]), len(ids))]
    place: dict[bytes, int] = {}
    back = np.fromiter((place.setdefault(c, len(place)) for c in cls[both]), np.int64, len(both))
    at = np.zeros(len(place), np.int64)
    at[back] = both
    links = np.bincount(back, weights=n[np.concatenate([b, a])], minlength=len(place)).astype(np.int64)
    return cls[at], rep[at], links, root[np.searchsorted(ids, rep[at])]
