"""Operators over documents against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import deduped, documents, frame, near_groups

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module", params=[False, True], ids=["plain", "clashing names"])
def docs(spark, request):
    return frame(spark, documents(), request.param).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_jaccard_join(docs, none):
    from weftline.llm.jaccard_join import jaccard_join

    got = jaccard_join(docs).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id is not None) == near_groups(documents())
    idle = [r for r in got if r.doc_id is None]
    assert len(idle) == 2 and all(r.class_id is None and r.n_links == 0 and r.kept for r in idle)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got if r.doc_id is not None)
    assert jaccard_join(none).count() == 0


def test_jaccard_join_over_blocks(spark, monkeypatch):
    """A large group of near copies, dealt out in many blocks."""
    import random

    from weftline.llm import jaccard_join as module

    monkeypatch.setattr(module, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(80)] = f"c{rng.randrange(9)}"
        rows.append((k, " ".join(w)))
    got = module.jaccard_join(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == near_groups(rows)


def test_posterior_bounds():
    from weftline.llm.jaccard_join import STEPS, least_matches

    least = least_matches(0.8, 1e-6)
    assert all(0 < m < 0.8 * n for m, n in zip(least, STEPS, strict=True))


def test_line_dedup(docs, none):
    from weftline.llm.line_dedup import dedup_lines

    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_deleted"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == deduped(documents())
    assert dedup_lines(none).count() == 0


def test_line_dedup_names_and_repeats(spark):
    """Columns of any name; rows without an id, and repeated rows, are told apart."""
    from weftline.llm.line_dedup import dedup_lines

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (None, long), (7, long), (7, long), (8, "short"), (8, "short"), (9, f"{long}\nmore\n{long}")]
    docs = frame(spark, rows).selectExpr("*", "1 as SLOT", "'a' as n_lines", "2 as N_DELETED", "3 as num", "4 as row", "5 as c0")
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "SLOT", "num", "row", "c0", "n_lines", "n_deleted"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in got.collect()), key=str) == sorted(
        [(None, "", 1, 1), (None, "", 1, 1), (7, long, 1, 0), (7, "", 1, 1), (8, "short", 1, 0), (8, "short", 1, 0), (9, "more", 3, 2)], key=str
    )


def test_line_dedup_of_a_row_repeated_often(spark):
    from weftline.llm.line_dedup import dedup_lines

    text = "\n".join(" ".join(f"w{i}" for i in range(k, k + 20)) for k in range(4))
    got = dedup_lines(frame(spark, [(1, text)] * 10_000)).groupBy("n_deleted").count().collect()
    assert {r.n_deleted: r["count"] for r in got} == {0: 1, 4: 9_999}


@pytest.mark.parametrize("seed", range(3))
def test_suffix_intervals(spark, seed):
    """Few different lines, so that runs of many lengths repeat within and between texts."""
    import random

    from weftline.llm.line_dedup import dedup_lines

    rng = random.Random(seed)
    rows = [(i, "\n".join("ab cd ef gh".split()[rng.randrange(3)] for _ in range(rng.randrange(30)))) for i in range(12)]
    got = dedup_lines(frame(spark, rows), min_words=5).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == deduped(rows, 5)


def backoff(rows, alpha=0.4, leave_out=True):
    texts = [(t or "").lower().split() for _, t in rows]
    own = [[Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in (1, 2, 3)] for w in texts]
    total = [sum((o[n] for o in own), Counter()) for n in range(3)]
    big = sum(map(len, texts))
    out = []
    for (i, _), w, o in zip(rows, texts, own, strict=True):
        o = o if leave_out else [Counter()] * 3
        rest, score = max(big - len(w) * leave_out, 1), 0.0
        for k in range(len(w)):
            for n in (3, 2, 1):
                gram = tuple(w[k - n + 1 : k + 1])
                c = total[n - 1][gram] - o[n - 1][gram] if k >= n - 1 else 0
                if c > 0:
                    below = total[n - 2][gram[:-1]] - o[n - 2][gram[:-1]] if n > 1 else rest
                    score += (3 - n) * math.log(alpha) + math.log(c / below)
                    break
            else:
                score += 3 * math.log(alpha) - math.log(rest)
        out.append((i, len(w), score))
    return sorted(out, key=str)


def test_backoff_scores(docs, none):
    from weftline.llm.lm_score import backoff_scores

    for leave_out in (True, False):
        got = backoff_scores(docs, leave_out=leave_out).collect()
        want = backoff(documents(), leave_out=leave_out)
        assert sorted((g.doc_id or -1, g.n_words, round(g.log_score, 3)) for g in got) == sorted((w[0] or -1, w[1], round(w[2], 3)) for w in want)
        assert all(abs(g.score * g.n_words - g.log_score) < 1e-2 * max(1, g.n_words) for g in got)
    assert backoff_scores(none).count() == 0


def test_backoff_scores_in_many_parts(spark, tmp_path, monkeypatch):
    """Small blocks and parts, an input straight from files and one that passes through a shuffle."""
    from weftline.llm import lm_score as module

    monkeypatch.setattr(module, "PART", 5000)
    monkeypatch.setattr(module, "BLOCK", 3000)
    rows = documents()
    frame(spark, rows).write.parquet(str(tmp_path / "docs"))
    files = spark.read.parquet(str(tmp_path / "docs"))
    want = sorted((w[0] or -1, w[1], round(w[2], 3)) for w in backoff(rows))
    for docs in (files, files.repartition(3)):
        assert module._from_files(docs.select("doc_id", "text")) == (docs is files)
        got = module.backoff_scores(docs).collect()
        assert sorted((g.doc_id or -1, g.n_words, round(g.log_score, 3)) for g in got) == want


def test_token_counts(docs, none, tokenizer):
    from weftline.llm.token_counts import count_tokens

    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, P.path("byte_bpe_50k.json")).collect()), key=str)
    want = []
    for i, t in documents():
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert count_tokens(none, P.path("byte_bpe_50k.json")).count() == 0


def test_bpe_round_trip(docs, none, tokenizer):
    from weftline.llm.bpe_chunks import decode_documents, encode_documents

    path = P.path("byte_bpe_50k.json")
    ids = encode_documents(docs, path)
    got = sorted(((r.doc_id, bytes(r.ids)) for r in ids.collect()), key=str)
    want = [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()) for i, t in documents()]
    assert got == sorted(want, key=str)
    texts = decode_documents(ids, path).collect()
    assert sorted(((r.doc_id, r.text) for r in texts), key=str) == sorted(((i, t or "") for i, t in documents()), key=str)
    digest = {r.doc_id: r for r in encode_documents(docs, path, digest=True).collect()}
    assert digest[103].decoded_sha256 == hashlib.sha256(b"one two").hexdigest() and digest[100].n_tokens == 0
    assert encode_documents(none, path, digest=True).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", " ", "  ", "\n", "é", "漢", "'s", "'", "12", "!?", "<|endoftext|>", "😀", "\t", " ", "end"]), max_size=60), st.lists(st.integers(0, 200), max_size=5))
def test_joints_are_repaired(parts, cuts):
    from weftline.llm.bpe import encoder, read_tokenizer
    from weftline.llm.bpe_chunks import assemble

    enc = encoder(read_tokenizer(P.path("byte_bpe_50k.json")))
    text = "".join(parts)
    cuts = sorted({min(c, len(text)) for c in cuts} | {0, len(text)})
    chunks = [np.frombuffer(enc.encode_all([text[a:b]])[0], "<u4") for a, b in zip(cuts, cuts[1:], strict=False)]
    want = enc.library.encode(text, add_special_tokens=False).ids
    assert assemble(enc, chunks).tolist() == want and enc.encode(text).tolist() == want


def long_texts():
    """Texts without ASCII white space: Chinese with and without punctuation, base64."""
    import base64
    import random

    rng = random.Random(3)
    han = [chr(0x4E00 + rng.randrange(3000)) for _ in range(400_000)]
    marked = [c + "，" if k % 17 == 0 else c for k, c in enumerate(han)]
    return {"marked": "".join(marked), "plain": "".join(han[:60_000]), "base64": base64.b64encode(rng.randbytes(900_000)).decode()}


@pytest.mark.parametrize("kind", ["marked", "plain", "base64"])
def test_joints_of_long_texts_without_white_space(tokenizer, kind):
    """Put together from chunks in a small multiple of the library's own time."""
    import time

    from weftline.llm.bpe import encoder, read_tokenizer
    from weftline.llm.bpe_chunks import assemble, boundaries

    enc = encoder(read_tokenizer(P.path("byte_bpe_50k.json")))
    text = long_texts()[kind]
    data = text.encode()
    ends = boundaries([data])[0]
    chunks = [enc.encode(data[a:b].decode()) for a, b in zip([0, *ends], ends, strict=False)]
    assert len(chunks) > 20
    began = time.perf_counter()
    want = tokenizer.encode(text, add_special_tokens=False).ids
    library = time.perf_counter() - began
    began = time.perf_counter()
    assert assemble(enc, chunks).tolist() == want
    assert time.perf_counter() - began < 8 * library + 2


def test_a_row_repeated_often(spark, tokenizer):
    """One row 10,000 times: every operator splits it and returns as many rows."""
    from weftline.llm.bpe_chunks import encode_documents
    from weftline.llm.jaccard_join import jaccard_join
    from weftline.llm.packing import best_fit_pack
    from weftline.llm.token_counts import count_tokens

    text = " ".join(f"w{i}" for i in range(300))
    docs = frame(spark, [(1, text)] * 10_000)
    n = len(tokenizer.encode(text, add_special_tokens=False).ids)
    path = P.path("byte_bpe_50k.json")
    assert [tuple(r) for r in encode_documents(docs, path, digest=True).groupBy("doc_id", "n_tokens").count().collect()] == [(1, n, 10_000)]
    assert [tuple(r) for r in count_tokens(docs, path).groupBy("doc_id", "n_tokens").count().collect()] == [(1, n, 10_000)]
    assert [tuple(r) for r in jaccard_join(docs).groupBy("class_id", "n_links", "kept").count().collect()] == [(1, 9_999, True, 10_000)]
    packed = best_fit_pack(docs, capacity=400)
    assert packed.count() == packed.select("bin").distinct().count() == 10_000  # one cluster: no two in a bin


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.95])
def test_jaccard_join_at_other_thresholds(spark, threshold):
    import random

    from weftline.llm.jaccard_join import banding, jaccard_join

    rng = random.Random(2)
    rows = []
    for k in range(12):
        base = [f"t{k}x{i}" for i in range(60)]
        for j in range(5):
            w = list(base)
            for _ in range(j):
                w[rng.randrange(60)] = f"c{rng.randrange(99)}"
            rows.append((10 * k + j, " ".join(w)))
    got = jaccard_join(frame(spark, rows), threshold=threshold).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == near_groups(rows, threshold)
    assert banding(0.8) == (32, 4)
    with pytest.raises(ValueError):
        banding(0.05)


def test_pre_tokens_of_every_latin_character(tokenizer):
    from weftline.llm.bpe import encoder, read_tokenizer

    enc = encoder(read_tokenizer(P.path("byte_bpe_50k.json")))
    for c in map(chr, range(256)):
        for text in (c, f"a{c}b", f"a {c} b", f" {c}{c}1", f"{c}\n {c}"):
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            assert enc.encode(text).tolist() == ids, repr(text)
            assert sum(enc.piece_counts(enc.pre_tokens(text)[0])) == len(ids), repr(text)


def test_packing(docs, none):
    from weftline.llm.packing import best_fit_pack

    rows = documents()
    got = best_fit_pack(docs, capacity=100).collect()
    lengths = Counter()
    bins = defaultdict(list)
    for r in got:
        lengths[r.doc_id] += r.length
        bins[r.bin].append(r)
        assert r.length <= 100 and r.start == 100 * r.piece
    want = Counter()
    for i, t in rows:
        want[i] += len(re.findall(r"[^ \t\n\r\f\v]+", t or ""))
    assert {k: v for k, v in lengths.items() if v} == {k: v for k, v in want.items() if v}
    source = {i: (i or 0) % 3 for i, _ in rows}
    for held in bins.values():
        assert sum(r.length for r in held) <= 100
        assert sorted(r.position for r in held) == list(range(len(held)))
        rests = [r for r in held if r.length < 100]
        assert len({source[r.doc_id] for r in rests}) == len(rests)
    assert len({(r.doc_id, r.piece) for r in got if r.doc_id not in (None, 160)}) == len([r for r in got if r.doc_id not in (None, 160)])
    assert best_fit_pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 3), st.integers(0, 4)), max_size=40))
def test_packing_is_the_tightest_compatible(items):
    from weftline.llm.packing import pack_shard

    lengths, sources, clusters = ([x[k] for x in items] for k in range(3))
    got = pack_shard(lengths, [1 << s for s in sources], [1 << c for c in clusters], 10)
    bins: list[list] = []  # brute force: scan all bins for the least residual that fits
    want = []
    for row, n in enumerate(lengths):
        full = max(0, -(-n // 10) - 1)
        for p in range(full):
            bins.append([10, set(), set(), 1])
            want.append((row, p, p * 10, 10, len(bins) - 1, 0))
    rests = sorted(((max(0, -(-n // 10) - 1) * 10 - n, row) for row, n in enumerate(lengths)))
    for minus, row in rests:
        n = -minus
        fit = [(10 - b[0], k) for k, b in enumerate(bins) if 10 - b[0] >= n and 10 - b[0] > 0 and sources[row] not in b[1] and clusters[row] not in b[2]]
        if fit:
            k = min(fit)[1]
        else:
            bins.append([0, set(), set(), 0])
            k = len(bins) - 1
        b = bins[k]
        b[0] += n
        b[1].add(sources[row])
        b[2].add(clusters[row])
        want.append((row, (lengths[row] - n) // 10, lengths[row] - n, n, k, b[3]))
        b[3] += 1
    assert got == want


def test_shared_shingles_by_ranges(monkeypatch):
    """Large sets are compared by ranges of values, each of which takes little memory, and counts are those of whole sets."""
    import numpy as np

    from weftline.llm import jaccard_join

    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 300, 250, 7, 380, 90)]
    a, b = (np.tile(x, 2) for x in np.triu_indices(6, 1))
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]
    most, add = [], jaccard_join._add_shared
    monkeypatch.setattr(jaccard_join, "SHARE", 64)
    monkeypatch.setattr(jaccard_join, "_add_shared", lambda some, total: (most.append(sum(map(len, some))), add(some, total)))
    assert jaccard_join.intersections(sets, a, b).tolist() == want
    assert max(most) < 300 and sum(most) == sum(map(len, sets))
