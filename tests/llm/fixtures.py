"""Small inputs with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import random

WORDS = "der the ab cd ef gh of and in to reed best stone river cloud lamp quiet paper green".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "er", "ing"]) for _ in range(n))


def documents() -> list[tuple]:
    """doc_id, text, lang, source, n_chars and columns with clashing names."""
    rng = random.Random(5)
    texts: list[str | None] = [None, "", " \n\t ", "a", "x" * 50, "x" * 300, "one two", sentence(rng, 30)]
    base = sentence(rng, 120)
    words = base.split()
    texts += [base, base, base.upper()]
    for k in range(14):  # near copies, some of them of each other
        w = list(words)
        for _ in range(1 + k % 4):
            w[rng.randrange(len(w))] = f"new{k}"
        texts.append(" ".join(w))
    passage = sentence(rng, 25)
    texts += [sentence(rng, 60) + " " + passage + " " + sentence(rng, 40) for _ in range(6)]
    texts += [sentence(rng, rng.randrange(1, 400)) for _ in range(20)]
    texts += ["größe ñandú " * 30, "日本語のテキスト。" * 20, "line\nline\nother\n\nline", sentence(rng, 6000), "ab\x00cd" * 40]
    rows = [(i * 3 + 1, t, "en" if i % 2 else None, f"src{i % 3}", None if t is None else len(t), "x", 1.0, 7, "b") for i, t in enumerate(texts)]
    rows.append(rows[8])  # a repeated row
    rows.append((None, base, None, None, 5, None, None, None, None))
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, score double, ids int, _quality string"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def shingles(text: str | None, words: int) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute_components(rows: list[tuple[int, str | None]], words: int, num: int, den: int) -> dict[int, int]:
    sets = {i: shingles(t, words) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: root(i) for i in ids}


def brute_removed(rows: list[tuple[int | None, str | None]], width: int = 50) -> list[tuple[int, int, bytes]]:
    """For each row: bytes removed, runs, bytes kept. Rows of one id are one document; a null id comes last."""
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    raws = [(t or "").encode() for _, t in rows]
    first: dict[bytes, tuple] = {}
    for i in sorted(range(len(rows)), key=order):
        for k in range(len(raws[i]) - width + 1):
            first.setdefault(raws[i][k : k + width], order(i))
    out = []
    for i, raw in enumerate(raws):
        gone = bytearray(len(raw))
        for k in range(len(raw) - width + 1):
            if first[raw[k : k + width]] < order(i):
                gone[k : k + width] = b"\1" * width
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((sum(gone), runs, bytes(b for b, g in zip(raw, gone) if not g)))
    return out
