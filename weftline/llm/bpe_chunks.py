"""BPE encoding and decoding with reuse of content-defined chunks (operator 6)."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import Encoder, encoder, read_tokenizer
from weftline.llm.common import FILTER_BITS, mix, pack, passes, releasing, slot_filter, take, text_parts, unpack
from weftline.plans.stages import Stages

#: Bits of the rolling hash that are 0 at a boundary; least and most bytes of a chunk.
MASK, LEAST, MOST = (1 << 10) - 1, 256, 8192
#: Places where every pre-token ends, whatever stands around: after a letter or digit that no other follows, and before white space.
_CUT = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=\s)")
_IDS = "doc_id long, ids binary"
_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def boundaries(datas: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of UTF-8 texts: where the hash of the last 8 bytes says so.

    A boundary depends on its neighbourhood alone, so a passage has the same
    chunks in every document, but for those at its ends. The hash rolls over all
    texts at once; it cannot reach across a start, as a chunk has LEAST bytes.
    """
    whole = b"".join(datas)
    h = np.zeros(max(0, len(whole) - 7), np.uint64)
    for k in range(min(8, len(h))):
        h[k::8] = np.frombuffer(whole, "<u8", count=(len(whole) - k) // 8, offset=k)
    at = np.flatnonzero((mix(h) >> np.uint64(20)) & np.uint64(MASK) == 0) + 8
    starts = np.concatenate([[0], np.cumsum([len(x) for x in datas])])
    cuts = np.searchsorted(at, starts)
    return [_ends(x, at[a:b] - s) for x, s, a, b in zip(datas, starts, cuts, cuts[1:], strict=False)]


def _ends(data: bytes, candidates: np.ndarray) -> list[int]:
    ends, last = [], 0
    for at in candidates.tolist():
        while at - last > MOST:
            last = _character(data, last + MOST)
            ends.append(last)
        at = _character(data, at)
        if at - last >= LEAST and at < len(data):
            ends.append(at)
            last = at
    while len(data) - last > MOST:
        last = _character(data, last + MOST)
        ends.append(last)
    return ends if ends and ends[-1] == len(data) else [*ends, len(data)]


def _character(data: bytes, at: int) -> int:
    """The next place at which a character starts."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def encode_documents(docs: DataFrame, tokenizer: str, *, digest=False, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, ids binary) of every document; ids are little-endian unsigned 32-bit integers.

    With ``digest``, the ids are decoded again where they were made, and the
    result is (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Texts are cut by content into chunks. A chunk that more than one place of
    the corpus holds is encoded once; documents that hold such chunks are put
    together from them, and the text around each joint is encoded again, until
    what is encoded again agrees with the chunks at its ends (see ``assemble``). A
    document of which no chunk occurs elsewhere is encoded where it is read,
    without a shuffle.

    Which documents hold shared chunks reaches the readers as a bitmap of 1 MiB.
    In a table so large that it fills up, more documents take the way through
    the shuffle; results are the same.

    ``tokenizer`` is a byte-level BPE of the ``tokenizers`` library; special
    strings in a text become their ids, as is the library's default. A null text
    counts as an empty one and has no ids. A very long text takes time in
    proportion to its length, also without white space. Repeated rows return as
    many rows but are put together once, a null id stays null, further columns
    are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    give, schema = (_digest, _DIGEST) if digest else (_ids, _IDS)
    source = spark.sparkContext.broadcast(read_tokenizer(tokenizer))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = keyed.withColumn("row", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    keyed = keyed.withColumn("slot", F.pmod(F.xxhash64("doc_id", "row"), F.lit(FILTER_BITS)))

    chunks = stages.write(keyed.mapInArrow(_chunk_lists, "doc_id long, row binary, slot long, seq int, hash binary"))
    shared = stages.write(chunks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    bits = spark.sparkContext.broadcast(slot_filter(chunks.join(shared, "hash", "left_semi")))
    stages.drop(shared)

    alone = keyed.mapInArrow(partial(_encode_alone, source=source, bits=bits, give=give), schema)

    texts = keyed.mapInArrow(partial(_chunk_texts, bits=bits), "hash binary, data binary")
    once = texts.groupBy("hash").agg(F.first("data").alias("data"))
    encoded = once.mapInArrow(partial(_encode_chunks, source=source), "hash binary, ids binary")
    lists = chunks.mapInArrow(partial(_flagged, bits=bits), chunks.schema)
    lists = lists.groupBy("doc_id", "row", "seq", "hash").agg(F.count("*").cast("int").alias("copies"))  # rows with this id and text
    met = lists.join(encoded, "hash").select("doc_id", "row", "copies", F.struct("seq", "ids").alias("part"))
    gathered = met.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.first("copies").alias("copies"))
    joined = gathered.select("doc_id", "copies", "parts").mapInArrow(partial(_join_chunks, source=source, give=give), schema)
    return alone.unionByName(joined)


def decode_documents(ids: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) for rows (doc_id, ids binary)."""
    source = ids.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    return ids.select("doc_id", "ids").mapInArrow(partial(_decode, source=source), "doc_id long, text string")


def _selected(batches, bits=None, flagged=True):
    """Batches of bounded size with their texts; with bits, of rows whose slot is, or isn't, set."""
    for batch in batches:
        if bits is not None:
            keep = passes(bits.value, take(batch, "slot"))
            batch = batch.filter(pa.array(keep if flagged else ~keep))
        for lo, hi, texts in text_parts(batch, "text", 1 << 20):
            yield batch.slice(lo, hi - lo), texts


def _spans(texts: list[str]) -> list[list[tuple[bytes, bytes]]]:
    """(hash, UTF-8) of each chunk of each text."""
    datas = [t.encode() for t in texts]
    out = []
    for data, ends in zip(datas, boundaries(datas), strict=True):
        chunks = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        out.append([(xxhash.xxh3_128_digest(c), c) for c in chunks])
    return out


def _batch(**columns):
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


@releasing
def _chunk_lists(batches):
    for batch, texts in _selected(batches):
        found = [[h for h, _ in x] for x in _spans(texts)]
        n = [len(x) for x in found]
        at = pa.array(np.repeat(np.arange(len(n)), n))
        yield _batch(
            doc_id=batch.column("doc_id").take(at),
            row=batch.column("row").take(at),
            slot=batch.column("slot").take(at),
            seq=pa.array([i for x in found for i in range(len(x))], pa.int32()),
            hash=pa.array([h for x in found for h in x], pa.binary()),
        )


def _flagged(batches, bits):
    for batch in batches:
        yield batch.filter(pa.array(passes(bits.value, take(batch, "slot"))))


@releasing
def _encode_alone(batches, source, bits, give):
    enc = encoder(source.value)
    for batch, texts in _selected(batches, bits, flagged=False):
        yield give(enc, batch.column("doc_id"), enc.encode_all(texts))


@releasing
def _chunk_texts(batches, bits):
    for _, texts in _selected(batches, bits):
        found = dict(x for spans in _spans(texts) for x in spans)
        yield _batch(
            hash=pa.array(found, pa.binary()), data=pa.array([pack(x) for x in found.values()], pa.binary())
        )


@releasing
def _encode_chunks(batches, source):
    enc = encoder(source.value)
    for batch in batches:
        texts = [unpack(x).decode() for x in batch.column("data").to_pylist()]
        ids = [_small(np.frombuffer(x, "<u4")) for x in enc.encode_all(texts)]
        yield _batch(hash=batch.column("hash"), ids=pa.array(ids, pa.binary()))


def _small(ids: np.ndarray) -> bytes:
    """Two bytes an id where that is enough, after a byte that says so."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.tobytes()


@releasing
def _join_chunks(batches, source, give):
    enc = encoder(source.value)
    for batch in batches:
        docs, out, held = [], [], 0
        for doc, copies, parts in zip(batch.column("doc_id").to_pylist(), take(batch, "copies").tolist(), batch.column("parts"), strict=True):
            chunks = [np.frombuffer(p["ids"], f"<u{p['ids'][0]}", offset=1).astype("<u4") for p in parts.as_py()]
            ids = assemble(enc, chunks).astype("<u4").tobytes()
            for _ in range(copies):
                docs.append(doc)
                out.append(ids)
                held += len(ids)
                if held > 1 << 22:
                    yield give(enc, pa.array(docs, pa.int64()), out)
                    docs, out, held = [], [], 0
        yield give(enc, pa.array(docs, pa.int64()), out)


def _bytes(enc: Encoder, ids: np.ndarray) -> bytes:
    return b"".join(map(enc.bytes_of.__getitem__, ids.tolist()))


def _cuts(enc: Encoder, ids: np.ndarray, reach: int, last: bool) -> tuple[int, int, int, int] | None:
    """The cut that is ``reach``-th from the joint and the one next to the joint, in ids and in bytes from the joint.

    Cuts are ends of ids too, and farther from the joint than a special string is
    long. None if there aren't as many.
    """
    n = 64
    while True:
        part = ids[-n:] if last else ids[:n]
        data, ends = _bytes(enc, part), np.cumsum(enc.length_of[part])
        skip = 0
        while last and skip < min(3, len(data)) and data[skip] & 0xC0 == 0x80:  # the rest of a character
            skip += 1
        text = data[skip:].decode("utf-8", "ignore")
        at = np.cumsum([0, *(len(c.encode()) for c in text)]) if not text.isascii() else np.arange(len(text) + 1)
        places = at[[m.start() for m in _CUT.finditer(text)]] + skip if text else np.zeros(0, np.int64)
        places = places[np.isin(places, ends)]
        away = len(data) - places if last else places
        places = places[away >= enc.longest_special]
        if len(places) >= reach:
            far, near = (places[-reach], places[-1]) if last else (places[reach - 1], places[0])
            count = np.searchsorted(ends, [far, near]) + 1  # ids that end there or before
            if last:
                return len(part) - int(count[0]), len(part) - int(count[1]), len(data) - int(far), len(data) - int(near)
            return int(count[0]), int(count[1]), int(far), int(near)
        if len(part) == len(ids):
            return None
        n *= 4


def assemble(enc: Encoder, chunks: list[np.ndarray]) -> np.ndarray:
    """The ids of a text from those of its chunks.

    Around each joint the text from a cut on the left to one on the right is
    encoded again. It goes some cuts beyond the nearest, so that what is encoded
    again holds ids that both sides already have; unless these agree, all joints
    are done again from cuts farther out, and in the end the text as a whole. A
    chunk without such cuts is a part of one window with its neighbours', so a
    text without any cut is encoded once, not once for each joint.
    """
    chunks = [c for c in chunks if len(c)]
    if len(chunks) < 2:
        return chunks[0] if chunks else np.zeros(0, "<u4")
    for reach in (2, 4, 16):
        found = _repaired(enc, chunks, reach)
        if found is not None:
            return found
    return enc.encode(b"".join(_bytes(enc, c) for c in chunks).decode())


def _repaired(enc: Encoder, chunks: list[np.ndarray], reach: int) -> np.ndarray | None:
    """The ids with all joints encoded again, or None if they don't agree with the chunks."""
    none = chunks[0][:0]
    out, window, before = [], [], none
    for i, ids in enumerate(chunks):
        head = _cuts(enc, ids, reach, last=False) if i else (0, 0, 0, 0)
        tail = _cuts(enc, ids, reach, last=True) if i + 1 < len(chunks) else (0, 0, 0, 0)
        if head is None or tail is None or head[0] + tail[0] > len(ids):
            if i + 1 < len(chunks) or head is None:  # no cut on both sides: the whole chunk belongs to the window
                window.append(ids)
                if i + 1 == len(chunks):
                    again = enc.encode(b"".join(_bytes(enc, w) for w in window).decode())
                    if not _agree(again, before, none):
                        return None
                    out.append(again)
                continue
        if i:
            window.append(ids[: head[0]])
            again = enc.encode(b"".join(_bytes(enc, w) for w in window).decode())
            if not _agree(again, before, ids[head[1] : head[0]]):
                return None
            out.append(again)
        stop = len(ids) - tail[0]
        out.append(ids[head[0] : stop])
        window, before = [ids[stop:]], ids[stop : len(ids) - tail[1]]
    return np.concatenate(out)


def _agree(again: np.ndarray, before: np.ndarray, after: np.ndarray) -> bool:
    """Whether the ids begin and end with these."""
    if len(again) < max(len(before), len(after)):
        return False
    return bool((again[: len(before)] == before).all() and (again[len(again) - len(after) :] == after).all())


def _ids(enc, doc_ids, ids):
    return _batch(doc_id=doc_ids, ids=pa.array(ids, pa.binary()))


def _digest(enc, doc_ids, ids):
    decoded = [hashlib.sha256(enc.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in ids]
    return _batch(
        doc_id=doc_ids,
        n_tokens=pa.array([len(x) // 4 for x in ids], pa.int64()),
        ids_sha256=pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
        decoded_sha256=pa.array(decoded, pa.string()),
    )


@releasing
def _decode(batches, source):
    enc = encoder(source.value)
    for batch in batches:
        texts = [enc.decode(np.frombuffer(x or b"", "<u4")).decode() for x in batch.column("ids").to_pylist()]
        yield _batch(doc_id=batch.column("doc_id"), text=pa.array(texts, pa.string()))
