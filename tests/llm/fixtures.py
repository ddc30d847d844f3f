"""Small tables with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
EXTRA = "slot long, row long, cls string, score string, length long, cluster string, part int, block string, rep long, x string, hash string, tile long"


def words(rng: random.Random, n: int, most: int = 400) -> list[str]:
    return [f"w{rng.randrange(most)}" for _ in range(n)]


def documents(seed: int = 1) -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, short ones, copies, near copies, a repeated row, a null id, shared lines, one long text."""
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.randrange(30, 120))) for _ in range(12)]
    passage = "\n".join(" ".join(words(rng, 20)) for _ in range(4))
    rows = list(enumerate(base))
    rows += [(100, None), (101, ""), (102, "  \n\t "), (103, "one two"), (104, "One  TWO"), (105, "x")]
    rows += [(110, base[0]), (111, base[0]), (112, base[0].upper())]
    for k in range(6):  # near copies of one text, of each other too
        w = base[1].split()
        for _ in range(k % 3):
            w[rng.randrange(len(w))] = "changed"
        rows.append((120 + k, " ".join(w)))
    rows += [(130 + k, f"{base[k + 2]}\n{passage}\n\n{base[k + 3]}") for k in range(4)]
    rows += [(140, "\n".join(["same line again"] * 40)), (141, " ".join(words(rng, 30_000, 3000)))]
    rows += [(150, "Ünïcode · 漢字テスト   😀 naïve <|endoftext|> it's 12,345   end \n\n"), (151, "<|endoftext|>"), (152, "é" * 3000), (153, " " * 500 + "a")]
    rows += [(160, base[5]), (160, base[5]), (None, base[6]), (None, None)]
    return rows


def frame(spark, rows, extra: bool = False):
    out = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)
    if extra:
        for column in EXTRA.split(", "):
            name, kind = column.split()
            out = out.selectExpr("*", f"cast(7 as {kind}) as {name}")
    return out


def shingles(text: str | None, n: int = 5) -> set:
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def near_groups(rows, threshold=0.8):
    """[(doc_id, class_id, n_links)] sorted, for rows with ids."""
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    n = len(rows)
    near = lambda a, b: bool(a) and bool(b) and len(a & b) >= threshold * len(a | b) - 1e-9
    links = {(a, b) for a in range(n) for b in range(n) if a != b and near(rows[a][1], rows[b][1])}
    group = {i: {i} for i, _ in rows}
    for a, b in links:
        x, y = group[rows[a][0]], group[rows[b][0]]
        if x is not y:
            x |= y
            for i in y:
                group[i] = x
    return sorted((i, min(group[i]), sum((a, b) in links for b in range(n))) for a, (i, _) in enumerate(rows))


def deduped(rows, min_words=50):
    """[(doc_id, text)]: texts without later copies of runs of lines, straight from the definition."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.md5((rows[k][1] or "").encode()).hexdigest()))
    lines = {k: (rows[k][1] or "").split("\n") for k in order}
    real = {k: [i for i, x in enumerate(lines[k]) if x.strip()] for k in order}
    first: dict[tuple, tuple] = {}
    gone: dict[int, set] = {k: set() for k in order}
    for k in order:
        own = [lines[k][i].strip() for i in real[k]]
        for s in range(len(own)):
            for e in range(s + 1, len(own) + 1):
                run = tuple(own[s:e])
                if sum(len(x.split()) for x in run) >= min_words:
                    key = (k, s)
                    if first.setdefault(run, key) != key:
                        gone[k] |= set(range(s, e))
                    if e - s > 60:
                        break
    out = []
    for k in range(len(rows)):
        cut = {real[k][i] for i in gone[k]}
        text = rows[k][1]
        out.append((rows[k][0], "\n".join(x for i, x in enumerate(lines[k]) if i not in cut) if cut else text))
    return sorted(out, key=str)
