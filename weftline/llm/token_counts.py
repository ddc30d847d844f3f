"""Token counts by pre-token (operator 8)."""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import encoder, read_tokenizer
from weftline.llm.common import pack, pack_integers, partitions, releasing, take, text_parts, unpack, unpack_integers
from weftline.plans.stages import Stages

#: Bytes of text in a block.
BLOCK = 32 << 20
_OWN = -1


def count_tokens(
    docs: DataFrame, tokenizer: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document.

    Documents' frequencies of pre-tokens are kept in blocks: a row with the
    packed frequencies of the block's documents, and a row (block, place, token)
    for each of its distinct pre-tokens. The distinct pre-tokens of all blocks
    are a table of their own, the pieces of each are counted once, and the counts
    are joined to the blocks' rows, from which each document gets its sum. No
    ids are ever held. A pre-token that every document holds is one row of a
    block, and the join is one that adaptive execution can split.

    ``tokenizer`` is a byte-level BPE of the ``tokenizers`` library. Its special
    strings in a text count as one token each, as is the library's default.

    A null text counts as an empty one: 0 bytes, 0 tokens. A very long text is a
    block of its own. Rows are independent, so repeated rows, repeated ids and
    null ids return as many rows. Columns besides these two are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    source = spark.sparkContext.broadcast(read_tokenizer(tokenizer))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = stages.write(rows.mapInArrow(partial(_blocks, source=source), "block long, place int, token string, data binary"))
    tokens = blocks.where("place >= 0").select("block", "place", "token")
    pieces = stages.write(tokens.select("token").distinct().mapInArrow(partial(_pieces, source=source), "token string, n int"))
    counted = tokens.join(pieces, "token").select("block", "place", "n", F.lit(None).cast("binary").alias("data"))
    own = blocks.where("place < 0").select("block", "place", F.lit(0).alias("n"), "data")
    met = counted.unionByName(own).repartition(partitions(spark), "block").sortWithinPartitions("block", "place")
    out = met.mapInArrow(_documents, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


@releasing
def _blocks(batches, source):
    """A row with the block's documents and their frequencies, and one for each of its pre-tokens."""
    enc = encoder(source.value)
    block = TaskContext.get().partitionId() << 33
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, texts in text_parts(batch, "text", BLOCK):
            index: dict[str, int] = {}
            words, times, base, size = [], [], [], []
            for text in texts:
                tokens, special = enc.pre_tokens(text)
                found = Counter(tokens)
                place = np.fromiter((index.setdefault(t, len(index)) for t in found), np.uint32, len(found))
                order = np.argsort(place)
                words.append(np.diff(place[order], prepend=np.uint32(0)))  # small numbers
                times.append(np.fromiter(found.values(), np.uint32, len(found))[order])
                base.append(special)
                size.append(len(text.encode()))
            own = ids[lo:hi]
            head = np.array([np.asarray(own.fill_null(0)), np.asarray(own.is_valid()), size, base, list(map(len, words))], np.int64)
            parts = [pack(head.tobytes()), pack_integers(np.concatenate(words)), pack_integers(np.concatenate(times))]
            lengths = np.array([hi - lo, *map(len, parts[:2])], np.int64).tobytes()
            yield _rows([block], [_OWN], [None], [lengths + b"".join(parts)])
            names = list(index)
            for at in range(0, len(names), 20_000):
                some = names[at : at + 20_000]
                yield _rows([block] * len(some), list(range(at, at + len(some))), some, [None] * len(some))
            block += 1


def _rows(block, place, token, data):
    columns = [pa.array(block, pa.int64()), pa.array(place, pa.int32()), pa.array(token, pa.string()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "place", "token", "data"])


@releasing
def _pieces(batches, source):
    enc = encoder(source.value)
    for batch in batches:
        n = enc.piece_counts(batch.column("token").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(n, pa.int32())], ["token", "n"])


@releasing
def _documents(batches):
    """The documents of each block, whose own row comes first and then the counts of its pre-tokens in order."""
    own, counts, name = None, [], None

    def out():
        n, a, b = np.frombuffer(own[:24], np.int64).tolist()
        ids, valid, size, base, entries = np.frombuffer(unpack(own[24 : 24 + a]), np.int64).reshape(5, n)
        steps, times = unpack_integers(own[24 + a : 24 + a + b], np.uint32), unpack_integers(own[24 + a + b :], np.uint32)
        ends = np.cumsum(entries)
        total = np.cumsum(steps, dtype=np.int64)
        before = np.concatenate([[0], total])[ends - entries]  # each document's places begin anew
        place = total - np.repeat(before, entries)
        pieces = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(pieces[place].astype(np.int64) * times)])
        found = base + sums[ends] - sums[ends - entries]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64(), mask=valid == 0), pa.array(size, pa.int64()), pa.array(found, pa.int64())],
            ["doc_id", "n_bytes", "n_tokens"],
        )

    for batch in batches:
        block, place, n = (take(batch, c) for c in ("block", "place", "n"))
        firsts = np.flatnonzero(place == _OWN)
        if name is not None:
            stop = firsts[0] if len(firsts) else len(block)
            counts.append(n[:stop])
        for k, at in enumerate(firsts):
            if name is not None:
                yield out()
            name, own = int(block[at]), batch.column("data")[int(at)].as_py()
            counts = [n[at + 1 : firsts[k + 1] if k + 1 < len(firsts) else len(block)]]
    if name is not None:
        yield out()
