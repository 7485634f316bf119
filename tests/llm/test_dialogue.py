import functools
import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import dialogue

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string, cost int"
LEGAL = re.compile(r"(s?(ua)+)?")


def key(r):
    _, turn, role, text = r
    return (turn is not None, turn or 0, role, text[:32], hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest())


def spaced(rows):
    return [(c, t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows]


def after_damage(rows):
    out = []
    for c, turn, role, text in spaced(rows):
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(c, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def brute(rows):
    """Report of one conversation by a search over all edits, with whole audits compared."""
    rows = sorted(rows, key=key)
    seen, faults = set(), []
    for _, _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated")
        seen.add((role, text))
    names = {"u": "user", "a": "assistant"}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def least(i, q, inserted=0):
        """(cost, audit, rows) from row i on after a row of state q; more than two rows in a row are never worth it."""
        ways, r = [], follow[q]
        if i == len(rows):
            if q in ("", "a"):
                ways.append((0, "", ()))
        else:
            cost, letters, out = least(i + 1, q)
            ways.append((cost + 2, "D" + letters, out))
            if faults[i] not in ("blank", "duplicate"):
                own, initial = 5 * (faults[i] == "truncated"), rows[i][2][:1]
                if initial == r or initial == "s" and q == "":
                    cost, letters, out = least(i + 1, initial)
                    ways.append((cost + own, "K" + letters, ((rows[i][2], rows[i][3]), *out)))
                cost, letters, out = least(i + 1, r)
                ways.append((cost + own + 1, "R" + letters, ((names[r], rows[i][3]), *out)))
        if inserted < 2:
            cost, letters, out = least(i, r, inserted + 1)
            ways.append((cost + 5, "I" + letters, ((names[r], ""), *out)))
        return min(ways, default=(10**9, "", ()))

    cost, letters, out = least(0, "")
    assert LEGAL.fullmatch("".join(role[0] for role, _ in out))
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{role}:{text}" for role, text in out)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest()), list(out)


def conversations(seed, n, longest):
    rng, rows = random.Random(seed), []
    for c in [None, *range(n)]:
        kind = rng.random()
        for k in range(rng.randrange(1, longest)):
            turn = None if rng.random() < 0.05 else k + rng.randrange(3) * (kind < 0.3)
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.6 else rng.choice(["system", "tool", None, "", "u", "Assistant", "users"])
            role = ("user", "assistant")[k % 2] if kind > 0.6 and rng.random() < 0.9 else role
            text = rng.choice(["Yes.", "No", "a b! \n", "", None, " \t", f"{k}.", f"{k}", "Wait?", "x" * 40 + str(k % 2) + ".", "é日"])
            rows.append((c, turn, role, text))
    rng.shuffle(rows)
    return rows


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture
def make(spark):
    def of(rows, parts=3):
        return spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA).repartition(parts)

    return of


@pytest.mark.parametrize("piece_rows, parts", [(4096, "2"), (1, "5"), (3, "40")])
def test_report_against_brute_force(spark, make, monkeypatch, piece_rows, parts):
    monkeypatch.setattr(dialogue, "PIECE_ROWS", piece_rows)
    rows = conversations(piece_rows, 60, 12) + [(999, 0, "user", "Once.")] * 40
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        whole = [tuple(r) for r in dialogue.repair_report(make(rows)).select("conv_id", *dialogue.REPORT).collect()]
        hurt = [tuple(r) for r in dialogue.repair_report(dialogue.damaged(make(rows))).select("conv_id", *dialogue.REPORT).collect()]
        edits = dialogue.repaired(make(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by_conv = grouped(spaced(rows))
    assert sorted(whole, key=str) == sorted(((c, *brute(x)[0]) for c, x in by_conv.items()), key=str)
    damaged = grouped(after_damage(rows))
    assert sorted(hurt, key=str) == sorted(((c, *brute(damaged.get(c, []))[0]) for c in by_conv), key=str)
    for c, x in by_conv.items():
        assert [(r.role, r.text) for r in sorted((r for r in edits if r.conv_id == c), key=lambda r: r.place)] == brute(x)[1]


def test_one_conversation_of_many_rows(spark, make, monkeypatch):
    monkeypatch.setattr(dialogue, "PIECE_ROWS", 500)
    rng = random.Random(9)
    rows = [(7, k, rng.choice(["user", "assistant", "assistant"]), rng.choice(["Ok.", f"{k}.", f"{k}"])) for k in range(12_000)]
    rows += [(7, 12_000, "user", "Same.")] * 3_000
    got = dialogue.repair_report(make(rows, 8)).first()
    piece, seen = dialogue.Piece(), set()
    for _, turn, role, text in rows:
        piece.add(turn, role, text, 1, False, (role, text) in seen, not text.endswith("."))
        seen.add((role, text))
    assert {k: got[k] for k in dialogue.REPORT} == dialogue.whole(piece)[0]


def test_table_holds_the_cost_from_state_to_state():
    rng = random.Random(4)
    for _ in range(200):
        pieces = []
        for _ in range(3):
            p = dialogue.Piece()
            for k in range(rng.randrange(5)):
                p.add(k, rng.choice(["user", "assistant", "system", "x"]), "t", rng.randrange(1, 3), rng.random() < 0.2, False, rng.random() < 0.3)
            pieces.append(p)
        after = dialogue.END
        for p in reversed(pieces):
            direct = dialogue.costs(p, after)[0]
            after = dialogue.chained(dialogue.table(p), after)
            assert after == direct


def test_empty_and_dropped(spark, make):
    none = spark.createDataFrame([], SCHEMA)
    assert dialogue.repair_report(none).count() == 0 and dialogue.repaired(none).count() == 0
    gone = [(c, t, "user", "Hello.") for c in range(40) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = dialogue.repair_report(dialogue.damaged(make(gone))).collect()
    assert {r.conv_id for r in got} == {g[0] for g in gone}
    assert {tuple(r[1:]) for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
