"""Stupid-backoff scores of documents under n-gram counts of the whole corpus (operator 4)."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import WordHashes, gram_hashes, pack, pack_integers, partitions, releasing, starts_of, take, text_parts, unpack, unpack_integers, whole_groups
from weftline.plans.stages import Stages

#: Bytes of text in a block, and those whose n-grams one part of the count tables holds, on average.
BLOCK, PART = 8 << 20, 8 << 20
_OWN = -1
_ROW = "block string, part int, data binary, counts binary"


def backoff_scores(docs: DataFrame, *, order=3, alpha=0.4, leave_out=True, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_words, log_score, score) of every document.

    Each word is scored by S(w | context) = c(context w) / c(context) where that
    n-gram was counted, else by ``alpha`` times the score with a context shorter
    by a word, and without a context by c(w) / N; a word that was not counted at
    all gets alpha ** order / N. With ``leave_out``, counts are those of all other
    documents: the whole corpus, less the document's own; with its own counts
    each of its n-grams has been seen, so that the model would never back off.
    log_score is the sum of the natural logarithms and score their mean, rounded
    to 6 places; words are lower-cased and separated by white space.

    The count tables are partitioned by n-gram hash, in parts whose number grows
    with the corpus. The n-grams of the documents are exploded in blocks: a block
    sends each of its distinct n-grams once, with its count, to the part that owns
    the hash. There the counts of all blocks are summed into that part of the
    table, which is joined to the n-grams that were sent, and each block gets the
    totals of its n-grams; its documents sum. An n-gram that all documents share
    is one entry of a block. A task holds one part of the table at a time.

    Hashes have 64 bits: among 10^12 different n-grams about one in 10^7 shares
    its hash and has too high a count. A text without words (null, empty, white
    space) has n_words 0 and scores 0. A very long text is a block of its own.
    Repeated rows count as documents of their own; null ids stay null; further
    columns are ignored; an empty table gives an empty result. The input is read
    more than once; unless it comes straight from files, it is staged first, so
    that all reads are alike.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    width = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not _from_files(rows):
        rows = stages.write(rows)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART))
    sent = rows.mapInArrow(partial(_send, order=order, parts=parts), _ROW)
    totals = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(_add, _ROW)  # a task for each part
    own = rows.mapInArrow(_own, _ROW)
    met = own.unionByName(totals).repartition(max(width, parts), "block").sortWithinPartitions("block", "part")
    scored = stages.write(
        met.mapInArrow(partial(_sum, order=order, alpha=alpha, parts=parts, leave_out=leave_out), "doc_id long, n_words long, logs double, bare long")
    )
    n = scored.agg(F.sum("n_words")).first()[0] or 0
    others = F.greatest(F.lit(n) - F.col("n_words"), F.lit(1)) if leave_out else F.lit(max(n, 1))  # the N of the counts
    score = F.col("logs") - F.col("bare") * F.log(others)
    mean = F.when(F.col("n_words") > 0, score / F.col("n_words")).otherwise(0.0)
    return scored.select("doc_id", "n_words", F.round(score, 6).alias("log_score"), F.round(mean, 6).alias("score"))


def _from_files(rows: DataFrame) -> bool:
    """Whether the rows are read from files and only projected or filtered, so that each read gives the same batches."""
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line.lstrip(" :+-").split(" ")[0].split("(")[0].split("[")[0] for line in plan.splitlines() if line.strip()]
    return nodes[-1].startswith("Relation") and all(x in ("Project", "Filter") for x in nodes[:-1])


def _blocks(batches):
    """(name, ids, texts) of bounded blocks, named by task, number and content."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, texts in text_parts(batch, "text", BLOCK):
            content = xxhash.xxh3_64()
            for text in texts:
                content.update(text)
            yield f"{task}-{number}-{content.hexdigest()}", ids[lo:hi], texts
            number += 1


def _grams(texts: list[str], order: int, cache: WordHashes):
    """(document of each word, [hash of the n words that end at each word, and whether they are of one document])."""
    words, offsets = cache.of(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    out = []
    for n in range(1, order + 1):
        h, inside = np.zeros(len(words), np.uint64), np.zeros(len(words), bool)
        if len(words) >= n:
            h[n - 1 :] = gram_hashes(words, n) + np.uint64(n)
            inside[n - 1 :] = doc[n - 1 :] == doc[: len(words) - n + 1]
        out.append((h, inside))
    return doc, np.diff(offsets), out


def _record(rows):
    block, part, data, counts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.string()), pa.array(part, pa.int32()), pa.array(data, pa.binary()), pa.array(counts, pa.binary())],
        ["block", "part", "data", "counts"],
    )


def _ranges(h: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of the hashes, which are sorted, begins and ends."""
    edges = [(p << 64) // parts for p in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(h, np.array(edges, np.uint64)), [len(h)]])


def _distinct(grams) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(sorted different hashes, how often each occurs, place of every n-gram among them for each order)."""
    every = np.concatenate([h[inside] for h, inside in grams])
    order = np.argsort(every)
    values = every[order]
    starts = starts_of(values)
    place = np.empty(len(every), np.int64)
    place[order] = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    ends = np.cumsum([inside.sum() for _, inside in grams])
    return values[starts[:-1]], np.diff(starts), np.split(place, ends[:-1])


@releasing
def _send(batches, order, parts):
    cache = WordHashes()
    for block, _, texts in _blocks(batches):
        h, times, _ = _distinct(_grams(texts, order, cache)[2])
        ends = _ranges(h, parts)
        rows = [
            (block, p, pack_integers(np.diff(h[a:b], prepend=np.uint64(0))), pack_integers(times[a:b].astype(np.uint32)))
            for p, (a, b) in enumerate(zip(ends, ends[1:], strict=False))
            if b > a
        ]
        if rows:
            yield _record(rows)


@releasing
def _add(batches):
    """To each block the totals of the n-grams that it sent, in the order it sent them."""
    for table in whole_groups(batches, "part"):
        parts, blocks = take(table, "part"), table.column("block").to_pylist()
        data, counts = table.column("data").to_pylist(), table.column("counts").to_pylist()
        starts = starts_of(parts)
        for a, b in zip(starts, starts[1:], strict=False):
            names, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for lo in range(a, b, 16):  # merge a few blocks at a time
                got = [np.cumsum(unpack_integers(x, np.uint64), dtype=np.uint64) for x in data[lo : min(b, lo + 16)]]
                more = [unpack_integers(x, np.uint32).astype(np.int64) for x in counts[lo : min(b, lo + 16)]]
                h, n = np.concatenate([names, *got]), np.concatenate([total, *more])
                order = np.argsort(h)
                h, n = h[order], n[order]
                first = starts_of(h)
                names, total = h[first[:-1]], np.add.reduceat(n, first[:-1])
            for i in range(a, b):
                h = np.cumsum(unpack_integers(data[i], np.uint64), dtype=np.uint64)
                yield _record([(blocks[i], int(parts[i]), b"", pack_integers(total[np.searchsorted(names, h)]))])


@releasing
def _own(batches):
    for block, ids, texts in _blocks(batches):
        valid = np.asarray(ids.is_valid())
        lengths = np.array([len(t.encode()) for t in texts], np.int64)
        head = np.array([np.asarray(ids.fill_null(0)), valid, lengths], np.int64).tobytes()
        yield _record([(block, _OWN, pack("".join(texts).encode()), pack(head))])


@releasing
def _sum(batches, order, alpha, parts, leave_out):
    cache = WordHashes()
    own, totals = None, {}

    def out():
        ids, valid, lengths = np.frombuffer(unpack(own[1]), np.int64).reshape(3, -1)
        data, ends = unpack(own[0]), np.cumsum(lengths)
        texts = [data[b - n : b].decode() for b, n in zip(ends, lengths, strict=True)]
        doc, n_words, grams = _grams(texts, order, cache)
        logs, bare = _scores(doc, len(texts), grams, totals, alpha, parts, leave_out)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64(), mask=valid == 0), pa.array(n_words, pa.int64()), pa.array(logs), pa.array(bare, pa.int64())],
            ["doc_id", "n_words", "logs", "bare"],
        )

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] == _OWN:  # a block's own row is its first
                if own is not None:
                    yield out()
                own, name, totals = (row["data"], row["counts"]), row["block"], {}
            elif own is None or row["block"] != name:
                raise ValueError("the documents were not the same when they were read again")
            else:
                totals[row["part"]] = row["counts"]
    if own is not None:
        yield out()


def _scores(doc, n_docs, grams, totals, alpha, parts, leave_out):
    """For each document, the sum of the logarithms without those of N, and how often N divides."""
    if not len(doc):
        return np.zeros(n_docs), np.zeros(n_docs, np.int64)
    h, _, places = _distinct(grams)
    ends = _ranges(h, parts)
    total = np.concatenate([unpack_integers(totals[p], np.int64) for p in range(parts) if ends[p + 1] > ends[p]])
    if len(total) != len(h):
        raise ValueError("the documents were not the same when they were read again")
    others = []  # for each order, the count
    for (_, inside), at in zip(grams, places, strict=True):
        count = np.zeros(len(doc), np.int64)
        if not leave_out:
            count[inside] = total[at]
            others.append(count)
            continue
        more = np.flatnonzero(total[at] > 1)  # what occurs once is the document's own
        where = np.flatnonzero(inside)[more]
        key = doc[where] * len(h) + at[more]
        by = np.argsort(key)
        own = np.diff(starts_of(key[by]))
        count[where[by]] = total[at[more[by]]] - np.repeat(own, own)
        others.append(count)
    logs, open_ = np.zeros(len(doc)), np.ones(len(doc), bool)
    order = len(grams)
    for n in range(order, 1, -1):
        seen = open_ & (others[n - 1] > 0)
        where = np.flatnonzero(seen)
        logs[where] = (order - n) * np.log(alpha) + np.log(others[n - 1][where]) - np.log(others[n - 2][where - 1])
        open_ &= ~seen
    single = open_ & (others[0] > 0)
    logs[single] = (order - 1) * np.log(alpha) + np.log(others[0][single])
    logs[open_ & ~single] = order * np.log(alpha)
    return np.bincount(doc, weights=logs, minlength=n_docs), np.bincount(doc[open_], minlength=n_docs)
