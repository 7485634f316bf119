"""Repair of conversations to an alternation of roles, at least cost, in pieces of any conversation's rows.

A repaired conversation has role initials `(s?(ua)+)?`. Keeping a row costs 0, giving it the role user or assistant 1,
deleting it 2, inserting an empty row of role user or assistant 5; a truncated row that stays costs 5 more; blank rows
and duplicates have to go.

The search is over the rows that stay. With G(p, q) the least cost of all from row p on after a row of state q (nothing
yet, s, u or a), a row j that stays in state r gives F(j, r) = own cost + G(j + 1, r), and the gap before it costs the
deletions between, a difference of prefix sums P, and the insertions that the pair of roles asks for:

    G(p, q) = min over r of 5 * inserts(q, r) + min over j >= p of (F(j, r) + P(j)) - P(p),    or the end

The inner minimum runs along, one for each state. Of the cheapest repairs the one whose audit, the initials of its edits
in order, is least in ASCII order is read off forwards: each letter leads to one state only, so the first letter that
keeps the cost is the right one.

Rows are dealt by ranges of conversation and turn, so that a conversation may lie in several tasks. Inside a task
a conversation that begins and ends there, and is no longer than a piece, is finished at once. Others become pieces,
each with the cost of its rows from every state to every state; those small tables are chained backwards, then every
piece is read off for each state that may come in, and the pieces are joined in order in a stream that holds one piece.
A SHA-256 runs from first byte to last, so that last step is one task for a conversation, over finished pieces.

Defined cases: a null role or text is one space; a null conv_id is a conversation of its own. Rows go by turn, nulls
first; rows of one turn by role, then by the first characters of the text, then by a hash of role and text. Repeated
rows are copies of which all but the first are duplicates. A conversation without rows gives zeros, an empty audit and
the hash of nothing. An empty table gives none. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Staged, importable

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
#: Rows inserted between a row of one state and the next of another; before the end.
BETWEEN = [[FAR, 0, 0, 1], [FAR, FAR, 0, 1], [FAR, FAR, 1, 0], [FAR, FAR, 0, 1]]
AT_END = [0, 2, 1, 0]
END = [INSERT * n for n in AT_END]
#: A piece ends at so many rows or characters.
PIECE_ROWS, PIECE_CHARS = 4_096, 8_000_000
#: What a row may be.
SOUND, CUT, GONE = range(3)
_SPACE = r"\x20\x09-\x0D"


def next_state(q: int) -> int:
    """The state of a row inserted or reroled after a row of state q."""
    return ASSISTANT if q == USER else USER


def price(q: int, r: int) -> int:
    n = BETWEEN[q][r]
    return FAR if n == FAR else INSERT * n


PRICE = [[price(q, r) for r in range(4)] for q in range(4)]


@dataclass
class Piece:
    """Rows of one conversation in order: roles and texts, copies, what each is, and counts over them."""

    roles: list[str] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, blank: bool, repeat: bool, truncated: bool) -> None:
        forced = blank or repeat
        self.roles.append(role)
        self.texts.append(None if forced else text)
        self.copies.append(copies)
        self.kinds.append(GONE if forced else CUT if truncated else SOUND)
        self.chars += 0 if forced else len(text)
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - (not repeat)
            self.truncated += not repeat and truncated
        here = role[:1]
        self.illegal += copies - 1 + (self.last is not None and self.last + here not in ("su", "ua", "au"))
        self.first, self.last = here if self.first is None else self.first, here
        if turn is not None:
            self.turns += self.high is None or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def follow(self, other: Piece) -> None:
        """Takes in the counts of the piece that comes next."""
        self.blank += other.blank
        self.duplicate += other.duplicate
        self.truncated += other.truncated
        self.illegal += other.illegal + (self.last is not None and other.first is not None and self.last + other.first not in ("su", "ua", "au"))
        self.first, self.last = other.first if self.first is None else self.first, self.last if other.last is None else other.last
        if other.low is not None:
            self.turns += other.turns - (self.high is not None and self.high == other.low)
            self.low, self.high = other.low if self.low is None else self.low, other.high

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def costs(piece: Piece, after: list[int]) -> list[list[int]]:
    """G(p, q) for all rows p of a piece and its end, where the rest costs after[q]."""
    n = len(piece.roles)
    total = sum(piece.copies) * DELETE
    out: list[list[int]] = [[]] * n + [list(after)]
    ahead = [FAR] * 4  # the running minimum of F(j, r) + P(j) for each r
    before = total
    for j in range(n - 1, -1, -1):
        copies, kind, rest = piece.copies[j], piece.kinds[j], out[j + 1]
        before -= copies * DELETE
        if kind != GONE:
            own = DELETE * (copies - 1) + (TRUNCATED if kind == CUT else 0) + before
            is_now = STATE.get(piece.roles[j][:1])
            for r in (USER, ASSISTANT):
                f = own + rest[r] + (0 if r == is_now else REROLE)
                if f < ahead[r]:
                    ahead[r] = f
            if is_now == SYSTEM and own + rest[SYSTEM] < ahead[SYSTEM]:
                ahead[SYSTEM] = own + rest[SYSTEM]
        a, s, u, w = total - before, ahead[SYSTEM] - before, ahead[USER] - before, ahead[ASSISTANT] - before
        out[j] = [min(a + after[0], s, u, w + INSERT), min(a + after[1], u, w + INSERT), min(a + after[2], u + INSERT, w), min(a + after[3], u, w + INSERT)]
    return out


def table(piece: Piece) -> list[int]:
    """Least cost of the piece's rows from each state (row) to each (column)."""
    ways = [costs(piece, [0 if q == e else FAR for q in range(4)])[0] for e in range(4)]
    return [ways[e][q] for q in range(4) for e in range(4)]


def chained(way: list[int], after: list[int]) -> list[int]:
    """What a piece with this table and all after it cost, by the state that comes in."""
    return [min(way[4 * q + e] + after[e] for e in range(4)) for q in range(4)]


def audit(piece: Piece, rest: list[list[int]], q: int) -> tuple[str, int]:
    """The least audit of the cheapest repair of the piece that begins in state q, and the state that it ends in."""
    out = []
    for j, role in enumerate(piece.roles):
        copies, kind = piece.copies[j], piece.kinds[j]
        if kind == GONE or DELETE * copies + rest[j + 1][q] == rest[j][q]:
            out.append("D" * copies)
            continue
        while INSERT + rest[j][next_state(q)] == rest[j][q]:
            out.append("I")
            q = next_state(q)
        own = DELETE * (copies - 1) + (TRUNCATED if kind == CUT else 0)
        r = STATE.get(role[:1])
        if r is not None and BETWEEN[q][r] == 0 and own + rest[j + 1][r] == rest[j][q]:
            out.append("K")
            q = r
        else:
            out.append("R")
            q = next_state(q)
        out.append("D" * (copies - 1))
    return "".join(out), q


def turns_of(piece: Piece, letters: str, q: int) -> Iterator[tuple[str, str, str]]:
    """Edit, role and text of each row that an audit leaves, given the state that comes in."""
    j, seen = 0, 0  # seen: copies of row j done
    for x in letters:
        if x == "I":
            q = next_state(q)
            yield x, ROLE[q], ""
            continue
        if x == "K":
            q = STATE[piece.roles[j][:1]]
            yield x, piece.roles[j], piece.texts[j]
        elif x == "R":
            q = next_state(q)
            yield x, ROLE[q], piece.texts[j]
        seen += 1
        if seen == piece.copies[j]:
            j, seen = j + 1, 0


class Digest:
    """SHA-256 of `role:text` lines as they come."""

    def __init__(self) -> None:
        self.sha, self.begun = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
        self.begun = True


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
COUNTS = ["blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns"]
ROWS = ["roles", "texts", "copies", "kinds"]
_REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_TURNS = "array<struct<edit: string, role: string, text: string>>"
_PIECE = "roles array<string>, texts array<string>, copies array<bigint>, kinds array<int>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns bigint"


def _schema(conv: T.DataType, fields: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), *T._parse_datatype_string(fields).fields])


def closing(q: int) -> tuple[str, list[tuple[str, str, str]]]:
    """Letters and rows that end a conversation in state q."""
    rows = []
    for _ in range(AT_END[q]):
        q = next_state(q)
        rows.append(("I", ROLE[q], ""))
    return "I" * len(rows), rows


def whole(piece: Piece) -> tuple[dict, list[tuple[str, str, str]]]:
    """Report and rows of a conversation that is one piece."""
    rest = costs(piece, END)
    letters, q = audit(piece, rest, NOTHING)
    more, last = closing(q)
    rows, sha = [*turns_of(piece, letters, NOTHING), *last], Digest()
    for _, role, text in rows:
        sha.add(role, text)
    values = (piece.gaps(), piece.blank, piece.duplicate, piece.truncated, piece.illegal, rest[0][NOTHING], letters + more, sha.sha.hexdigest())
    return dict(zip(REPORT, values)), rows


def _read(row: dict) -> Piece:
    piece = Piece(**{k: row[k] for k in ROWS})
    for k in COUNTS:
        setattr(piece, k, row[k])
    return piece


def cut(rows: Iterator[dict]) -> Iterator[dict]:
    """Sorted rows of a task as finished conversations and pieces; the task's first and last conversation may go on."""
    piece, conv, number, edge, before = Piece(), None, 0, True, None

    def as_piece() -> dict:
        return {"conv_id": conv[0], "piece": number, "way": table(piece)} | {k: getattr(piece, k) for k in (*ROWS, *COUNTS)}

    for r in rows:
        here = (r["conv_id"],)
        if conv is not None and here != conv:
            if edge or number:
                yield as_piece()
            else:
                report, turns = whole(piece)
                yield {"conv_id": conv[0], "report": report, "rows": [dict(zip(("edit", "role", "text"), x)) for x in turns]}
            piece, number, edge, before = Piece(), 0, False, None
        conv = here
        if r["copies"]:
            if len(piece.roles) >= PIECE_ROWS or piece.chars >= PIECE_CHARS:
                yield as_piece()
                piece, number = Piece(), number + 1
            piece.add(r["turn"], r["role"], r["text"], r["copies"], r["blank"], r["repeat"], r["truncated"])
    if conv is not None:
        yield as_piece()


def _faults(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0: a conversation that may have no rows), blank, repeat, truncated, tie columns."""
    # The hash stands for role and text in the search for repeats, which so moves no texts and counts before its shuffle.
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = conversations.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("key", key)
    order = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)).cast("bigint").alias("turn"))
    seen = conversations.filter("copies > 0").select("conv_id", key.alias("key"), order.alias("at")).groupBy("conv_id", "key").agg(F.min("at").alias("earliest"), F.max("at").alias("latest")).filter("earliest < latest")
    left, right = rows.alias("r"), seen.alias("s")
    joined = left.join(right, F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("r.key") == F.col("s.key")), "left")
    at = F.struct(F.col("r.turn").isNotNull(), F.coalesce("r.turn", F.lit(0)).cast("bigint").alias("turn"))
    out = joined.select("r.*", F.coalesce(at > F.col("s.earliest"), F.lit(False)).alias("repeat"))
    return (
        out.withColumn("blank", ~F.col("text").rlike(f"[^{_SPACE}]"))
        .withColumn("truncated", ~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z"))
        .withColumn("start", F.substring("text", 1, 32))
        .withColumn("text", F.when(~F.col("blank") & ~F.col("repeat"), F.col("text")))
    )


def _pieces(conversations: DataFrame) -> tuple[DataFrame, Staged]:
    """Finished conversations and pieces of all others, written to the shared folder."""
    importable(conversations.sparkSession)
    conv = conversations.schema["conv_id"].dataType
    schema = _schema(conv, f"part int, piece int, way array<bigint>, {_PIECE}, report struct<{_REPORT.replace(' bigint', ': bigint').replace(' string', ': string')}>, rows {_TURNS}")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, part, held, size = to_arrow_schema(schema), TaskContext.get().partitionId(), [], 0
        for row in cut(r for batch in batches for r in batch.to_pylist()):
            held.append(row | {"part": part})
            size += sum(map(len, row.get("roles") or ())) + sum(len(t or "") for t in row.get("texts") or ()) + sum(len(x["text"] or "") for x in row.get("rows") or ())
            if len(held) >= 2_000 or size >= PIECE_CHARS:
                yield pa.RecordBatch.from_pylist(held, kinds)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)

    rows = _faults(conversations)
    keys = ["conv_id", "turn", "role", "start", "key"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "copies", "blank", "repeat", "truncated")
    work = Staged()
    return work.table(ordered.mapInArrow(run, schema), "dialogue-pieces"), work


def _ends(pieces: DataFrame, conv: T.DataType) -> DataFrame:
    """For each piece what all after it costs by state, and what it and all after cost from nothing."""

    def chain(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["piece"]), reverse=True)
        after = END
        for r in rows:
            r["after"], after = after, chained(r["way"], after)
            r["cost"] = after[NOTHING]
        kinds = pa.schema([group.schema.field("conv_id"), pa.field("part", pa.int32()), pa.field("piece", pa.int32()), pa.field("after", pa.list_(pa.int64())), pa.field("cost", pa.int64())])
        return pa.Table.from_pylist([{k: r[k] for k in kinds.names} for r in rows], kinds)

    return pieces.select("conv_id", "part", "piece", "way").groupBy("conv_id").applyInArrow(chain, _schema(conv, "part int, piece int, after array<bigint>, cost bigint"))


def _joined(pieces: DataFrame, conv: T.DataType, turns: bool) -> DataFrame:
    """Conversations of several pieces: every piece is read off for all states, then they are put together in order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ends = _ends(pieces, conv).alias("e")
    p = pieces.alias("p")
    same = F.col("p.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("p.part") == F.col("e.part")) & (F.col("p.piece") == F.col("e.piece"))
    given = p.join(ends, same).select("p.conv_id", "p.part", "p.piece", *ROWS, *COUNTS, "e.after", "e.cost")
    read_schema = _schema(conv, f"part int, piece int, {_PIECE}, cost bigint, audits array<string>, states array<int>")
    out_schema = _schema(conv, f"part int, piece int, rows {_TURNS}" if turns else _REPORT)

    def read_off(batches):
        kinds = to_arrow_schema(read_schema)
        for batch in batches:
            for row in batch.to_pylist():
                piece, after = _read(row), row.pop("after")
                ways = [audit(piece, costs(piece, after), q) for q in range(4)]
                yield pa.RecordBatch.from_pylist([row | {"audits": [w[0] for w in ways], "states": [w[1] for w in ways]}], kinds)

    def put_together(batches):
        kinds = to_arrow_schema(out_schema)
        conv_id, sums, sha, letters, q, cost, at = None, None, None, [], NOTHING, 0, (0, 0)

        def finished():
            more, last = closing(q)
            for _, role, text in last:
                sha.add(role, text)
            if turns:
                return {"conv_id": conv_id[0], "part": at[0], "piece": at[1] + 1, "rows": [dict(zip(("edit", "role", "text"), x)) for x in last]}
            values = (sums.gaps(), sums.blank, sums.duplicate, sums.truncated, sums.illegal, cost, "".join(letters) + more, sha.sha.hexdigest())
            return {"conv_id": conv_id[0]} | dict(zip(REPORT, values))

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if conv_id != (row["conv_id"],):
                    if conv_id is not None:
                        yield pa.RecordBatch.from_pylist([finished()], kinds)
                    conv_id, sums, sha, letters, q, cost = (row["conv_id"],), Piece(), Digest(), [], NOTHING, row["cost"]
                piece = _read(row)
                sums.follow(piece)
                here = list(turns_of(piece, row["audits"][q], q))
                for _, role, text in here:
                    sha.add(role, text)
                letters.append(row["audits"][q])
                q, at = row["states"][q], (row["part"], row["piece"])
                if turns:
                    yield pa.RecordBatch.from_pylist([{"conv_id": conv_id[0], "part": at[0], "piece": at[1], "rows": [dict(zip(("edit", "role", "text"), x)) for x in here]}], kinds)
        if conv_id is not None:
            yield pa.RecordBatch.from_pylist([finished()], kinds)

    return given.mapInArrow(read_off, read_schema).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(put_together, out_schema)


def _counted(conversations: DataFrame) -> DataFrame:
    """The rows of a table, nulls of role and text as a space, each as one copy."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), space("role"), space("text"), F.lit(1).cast("bigint").alias("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of a table after damage by a checksum of conversation and turn; rows that are dropped have 0 copies."""
    name: Column = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(F.encode(name, "UTF-8")) % 20
    rows = _counted(conversations).withColumn("fault", fault)
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).cast("bigint")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def repair_report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    rows: conv_id, turn, role, text and copies, as from `damaged`; without copies every row counts once.
    """
    rows = rows if "copies" in rows.columns else _counted(rows)
    conv = rows.schema["conv_id"].dataType
    found, _ = _pieces(rows)
    done = found.filter(F.col("report").isNotNull()).select("conv_id", "report.*")
    return done.unionByName(_joined(found.filter(F.col("report").isNull()), conv, False))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R or I), role and text of every row of the repaired conversations; place grows in order."""
    rows = rows if "copies" in rows.columns else _counted(rows)
    conv = rows.schema["conv_id"].dataType
    found, _ = _pieces(rows)
    done = found.filter(F.col("report").isNotNull()).select("conv_id", "part", F.lit(0).alias("piece"), "rows")
    every = done.unionByName(_joined(found.filter(F.col("report").isNull()), conv, True))
    place = F.struct("part", "piece", "pos").alias("place")
    return every.select("conv_id", "part", "piece", F.posexplode("rows").alias("pos", "x")).select("conv_id", place, "x.edit", "x.role", "x.text")
