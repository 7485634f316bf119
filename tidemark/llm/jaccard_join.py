"""N-gram Jaccard join by universe partition.

Links all documents whose sets of word shingles have a Jaccard similarity of at
least num / den, without loss, and gives each document its connected component.

Sizes fall into bands. A band's pairs differ by at most h shingles, so the universe
of shingles is hashed into more than h segments: by the pigeonhole principle a
pair agrees on one segment at least. Each set is indexed by its segments' subsets;
segments that are empty on both sides prove nothing, so a few more segments are
made, and a set with more empty ones than that is also indexed by all subsets
with one shingle left out. The numbers come from the cheapest allocation.

Equal sets are one node. A signature that more than HOT sets have (a line or
passage that many documents share, say) is hot, and a band has some segments more
than it needs: similar sets agree on so many of them that a set may do without its
empty and its hot ones, as long as these don't outnumber the spare segments. Only
sets with more of them than that (the copies of a large group, mostly) meet in hot
signatures at all.

Sets that meet in a signature are paired with the least of them, their leader, only;
that many pairs are linear in the signatures. Most of them have a passage in common and
little else, so before any set is sent, each shows a parity sketch: a bit for each cell that
an odd number of its shingles falls into, one to two bits a shingle. Two sets differ by as many
shingles at least as their sketches by bits. Under each leader the sets that may be linked
by this bound fall into groups, each with its own least set as leader, and sets without
any such neighbour go (see near_groups; leaders of more than WIDE members are left as they are).
The exact comparison with the leader then keeps the symmetric differences where a leader has two members or more, and an
index of these differences finds every further link between members of one leader
(see links_beside). So no group is expanded into pairs, and no link is lost. Comparisons
of a leader with many members are salted. Components are found by alternating star steps.

Null and empty texts have the empty set and link with nothing. Rows with a null
doc_id link with nothing and have a null component. Rows with one doc_id and text
are one document. Empty tables give empty results. Extra columns are dropped by
jaccard_components and kept by one_of_each.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Staged, fresh, importable, slices, stage_table
from tidemark.llm.shingles import M1, M2, Sets, mix

BAND_RATIO = 1.5


class Plan:
    """Size bands and the number of segments of each, for similarity of at least num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.edge = [1]
        while self.edge[-1] < 1 << 40:
            self.edge.append(max(self.edge[-1] + 1, int(self.edge[-1] * max(BAND_RATIO, den / num)) + 1))

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.edge), size, "right") - 1

    @lru_cache(maxsize=None)  # noqa: B019
    def segments(self, band: int) -> tuple[int, int]:
        """Number of segments, and how many of them may be empty or hot.

        Sets of at most u shingles that are similar enough differ by at most h of them, so of h + 1 + slack
        segments they agree on slack + 1 at least. The slack is the cheapest one: more segments for each set
        against one-deletion variants for sets with more empty ones, and a share of h for hot ones. Sets that
        may not differ at all are equal, so they need no segment.
        """
        low, high = self.edge[band], self.edge[band + 1] - 1
        h = (self.den - self.num) * 2 * high // (self.den + self.num)
        if not h:
            return 0, 0
        best = None
        for empty in range(0, h + 2):
            slack = empty + 1 + h // 8
            m = h + 1 + slack
            mean = m * math.exp(-low / m) if m > 1 else 0.0
            term, tail = math.exp(-mean), 1.0
            for j in range(empty + 1):
                tail -= term
                term *= mean / (j + 1)
            cost = m + max(0.0, tail) * low
            if best is None or cost < best[0]:
                best = (cost, m, slack)
            if m > best[1] + 60:
                break
        return best[1], best[2]


def signatures(sets: Sets, plan: Plan, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the sets named by which, for each its set, and a code of the set's role.

    The code is 2 * (segments that may be hot + 1) + (1 if the set is the smaller one of a pair across bands);
    a set with too many empty segments has 0 + that.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    which = which[sets.size[which] > 0]
    own = plan.band(sets.size)
    edge = np.array(plan.edge)
    for up in (0, 1):
        # Up: as the smaller set of a pair whose larger one lies in the next band.
        pick = which if not up else which[sets.size[which] * plan.den >= edge[own[which] + 1] * plan.num]
        if not len(pick):
            continue
        pick = pick[[plan.segments(int(b))[0] > 0 for b in own[pick] + up]]
        if not len(pick):
            continue
        band = own[pick] + up
        m = np.array([plan.segments(int(b)) for b in range(int(band.max()) + 1)], np.int64)[band]
        flat = sets.flat[np.arange(int(sets.size[pick].sum())) + np.repeat(sets.offset[pick] - (np.cumsum(sets.size[pick]) - sets.size[pick]), sets.size[pick])]
        row = np.repeat(np.arange(len(pick)), sets.size[pick])
        # The segment rises with the shingle, so each one's shingles lie side by side.
        segment = ((flat >> np.uint64(32)) * m[row, 0].astype(np.uint64)) >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (row[1:] != row[:-1])]))
        term = mix(flat ^ M1)
        total = np.add.reduceat(term, begin)
        seg_row, seg = row[begin], segment[begin]
        salt = mix(seg * M2 + (band[seg_row].astype(np.uint64) << np.uint64(40)))
        filled = np.bincount(seg_row, minlength=len(pick))
        empty = m[:, 0] - filled
        poor = empty > m[:, 1]
        role = 2 * np.minimum(np.maximum(m[:, 1] - empty + 1, 0), 1 << 13) + up
        found.append((mix(total + salt), pick[seg_row], role[seg_row]))
        if poor.any():
            # Too many empty segments: every subset with one shingle left out as well.
            owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(flat))))
            large = np.bincount(owner)[owner] > 1
            one = poor[row] & large
            found.append((mix(total[owner[one]] - term[one] + salt[owner[one]]), pick[row[one]], role[row[one]]))
            bare = np.flatnonzero(empty * 4 > m[:, 0])
            if len(bare):
                r = np.repeat(bare, m[bare, 0])
                s = np.concatenate([np.arange(x) for x in m[bare, 0]]).astype(np.uint64)
                have = np.isin(r * (1 << 32) + s.astype(np.int64), seg_row * (1 << 32) + seg.astype(np.int64))
                found.append((mix(mix(s[~have] * M2 + (band[r[~have]].astype(np.uint64) << np.uint64(40)))), pick[r[~have]], role[r[~have]]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])


FLUSH = 3_000_000
#: Signatures in one bucket, about.
BUCKET = 1_500_000
#: Sets of one signature beyond which it is hot.
HOT = 32
#: Members that are compared with one copy of their leader.
SALTED = 256
#: Members of one leader up to which their sketches are compared.
WIDE = 4096
#: Bits of the smallest sketch.
BITS = 128


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sketches(sets: Sets) -> list[bytes]:
    """A parity sketch of each set, of the least power of two of bits that isn't below its size."""
    bits = np.maximum(BITS, 1 << np.ceil(np.log2(np.maximum(sets.size, 1))).astype(np.int64))
    start = np.cumsum(bits) - bits
    cell = start[sets.owner] + (sets.flat & (bits[sets.owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(cell, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little")
    return [odd[a // 8 : (a + n) // 8].tobytes() for a, n in zip(start, bits, strict=True)]


def node_table(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, node (fingerprint of the set, null for an empty one) and sketch."""

    def run(batches):
        for batch in slices(batches, "text"):
            sets = Sets(_bytes(batch.column("text")), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets.size), pa.array(sets.key, mask=sets.size == 0), pa.array(sketches(sets), pa.binary())], names=["doc_id", "n_shingles", "node", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, node bigint, sketch binary")


def _stars(sig: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Rows of (least node, other node) for each signature; rows are sorted by signature and node."""
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    lead = np.repeat(node[begin], np.diff(np.append(begin, len(sig))))
    return np.unique(np.stack([lead, node], 1)[lead != node], axis=0).reshape(-1, 2)


def meetings(docs: DataFrame, words: int, plan: Plan, buckets: int) -> DataFrame:
    """Who meets whom: leader and member for signatures that aren't hot; member, role and its hot signatures else.

    A record holds a bucket's signatures of one task: 40 bits of each in the order of sets, and of each set its
    node, role and number of signatures there.
    """

    def emit(sig: np.ndarray, node: np.ndarray, role: np.ndarray):
        bucket = (sig % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((role, node, bucket))
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        sig, node, role = sig[order], node[order], role[order]
        rows = []
        for b in np.flatnonzero(np.diff(ends)):
            at = slice(ends[b], ends[b + 1])
            n, r = node[at], role[at]
            head = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (r[1:] != r[:-1])]))
            size = np.diff(np.append(head, len(n)))
            rows.append((int(b), np.ascontiguousarray(sig[at].view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes(), n[head].tobytes(), r[head].astype("<u2").tobytes() + size.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "sigs", "nodes", "roles"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            sets = Sets(_bytes(batch.column("text")), words)
            # Equal sets within a task count once.
            fresh_ones = [k for k in np.unique(sets.key, return_index=True)[1] if sets.size[k] and int(sets.key[k]) not in seen]
            seen.update(int(sets.key[k]) for k in fresh_ones)
            sig, own, role = signatures(sets, plan, np.array(fresh_ones, np.int64))
            held.append((sig, sets.key[own], role))
            if sum(len(h[0]) for h in held) > FLUSH:
                yield from emit(*(np.concatenate([h[i] for h in held]) for i in range(3)))
                held = []
                seen.clear()
        if held:
            yield from emit(*(np.concatenate([h[i] for h in held]) for i in range(3)))

    def meet(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table["sigs"].to_pylist()), np.uint8).reshape(-1, 5)
        sig = np.zeros((len(raw), 8), np.uint8)
        sig[:, 3:] = raw
        sig = sig.view(np.uint64).ravel()
        heads = [np.frombuffer(x, np.int64) for x in table["nodes"].to_pylist()]
        blobs = list(zip(heads, table["roles"].to_pylist(), strict=True))
        size = np.concatenate([np.frombuffer(x[2 * len(h) :], "<u4") for h, x in blobs])
        node = np.repeat(np.concatenate(heads), size)
        role = np.repeat(np.concatenate([np.frombuffer(x[: 2 * len(h)], "<u2") for h, x in blobs]), size)
        order = np.lexsort((role, node, sig))
        sig, node, role = sig[order], node[order], role[order]
        # A set that several tasks sent counts once.
        once = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
        sig, node, role = sig[once], node[once], role[once]
        begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        long = np.diff(np.append(begin, len(sig)))
        hot = np.repeat(long > HOT, long)
        pairs = _stars(sig[~hot], node[~hot]) if not hot.all() else np.zeros((0, 2), np.int64)
        sig, node, role = sig[hot], node[hot], role[hot].astype(np.int64)
        order = np.lexsort((sig, role, node))
        sig, node, role = sig[order], node[order], role[order]
        head = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (role[1:] != role[:-1])])) if len(sig) else np.zeros(0, np.int64)
        ends = np.append(head, len(sig))
        n, b = len(head), table["bucket"][0].as_py()
        return pa.table({
            "bucket": pa.array(np.full(len(pairs) + n, b), pa.int64()),
            "leader": pa.array([*pairs[:, 0].tolist(), *[None] * n], pa.int64()),
            "member": pa.array(np.concatenate([pairs[:, 1], node[head]]), pa.int64()),
            "role": pa.array([*[None] * len(pairs), *role[head].tolist()], pa.int32()),
            "hot": pa.array([*[None] * len(pairs), *[sig[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)]], pa.binary()),
        })

    blobs = docs.select("text").mapInArrow(run, "bucket bigint, sigs binary, nodes binary, roles binary")
    return blobs.groupBy("bucket").applyInArrow(meet, "bucket bigint, leader bigint, member bigint, role int, hot binary")


def star_pairs(met: DataFrame) -> DataFrame:
    """leader, member: from signatures that aren't hot, and from hot ones between sets that can't do without them."""
    hot = met.filter("hot is not null")
    poor = hot.groupBy("member", "role").agg(F.sum(F.octet_length("hot") / 8).alias("n")).filter(F.col("n") > F.floor(F.col("role") / 2) - 1).select("member", "role")

    def stars(table: pa.Table) -> pa.Table:
        sigs = [np.frombuffer(x, np.uint64) for x in table["hot"].to_pylist()]
        node = np.repeat(table["member"].to_numpy(), [len(x) for x in sigs])
        sig = np.concatenate(sigs)
        order = np.lexsort((node, sig))
        pairs = _stars(sig[order], node[order])
        return pa.table({"leader": pairs[:, 0], "member": pairs[:, 1]})

    more = hot.join(poor, ["member", "role"], "left_semi").select("bucket", "member", "hot").groupBy("bucket").applyInArrow(stars, "leader bigint, member bigint")
    return met.filter("leader is not null").select("leader", "member").unionByName(more).distinct()


def near_groups(table: pa.Table, num: int, den: int) -> pa.Table:
    """Pairs of leader and member anew: for each group of sets that a chain of possible links joins, with its least set."""
    node, size = table["node"].to_numpy(), table["size"].to_numpy()
    node, first = np.unique(node, return_index=True)
    size = size[first]
    raw = table["sketch"].to_pylist()
    raw = [raw[i] for i in first]
    kind = np.array([len(x) for x in raw])
    of = {k: np.flatnonzero(kind == k) for k in np.unique(kind).tolist()}
    grid = {k: np.frombuffer(b"".join(raw[i] for i in at), np.uint64).reshape(len(at), -1) for k, at in of.items()}
    # Bits i and i + half of the larger sketch make up bit i of the smaller.
    fold = lambda m: m[..., : m.shape[-1] // 2] ^ m[..., m.shape[-1] // 2 :]
    half = {k: fold(m) for k, m in grid.items() if k > BITS // 8}
    place = np.zeros(len(node), np.int64)
    for at in of.values():
        place[at] = np.arange(len(at))
    new = np.ones(len(node), bool)
    out = []
    for lead in range(len(node)):
        if not new[lead]:
            continue
        new[lead] = False
        queue = [lead]
        while queue:
            x = queue.pop()
            k, at = int(kind[x]), place[x]
            # Sets that are similar enough have sketches of equal or neighbouring sizes.
            for other, mine, theirs in ((k, grid[k], grid.get(k)), (2 * k, grid[k], half.get(2 * k)), (k // 2, half.get(k), grid.get(k // 2))):
                if mine is None or theirs is None:
                    continue
                rest = of[other][new[of[other]]]
                if not len(rest):
                    continue
                apart = np.bitwise_count(theirs[place[rest]] ^ mine[at]).sum(1, dtype=np.int64)
                both = size[rest] + size[x]
                near = rest[(apart * (den + num) <= both * (den - num)) & (np.minimum(size[rest], size[x]) * den >= np.maximum(size[rest], size[x]) * num)]
                new[near] = False
                queue += near.tolist()
                out += [(int(node[lead]), int(node[y])) for y in near.tolist()]
    return pa.table({"leader": pa.array([o[0] for o in out], pa.int64()), "member": pa.array([o[1] for o in out], pa.int64())})


def sketched(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """leader, member: the pairs that the sketches leave, regrouped."""
    counts = pairs.groupBy("leader").agg(F.count("*").alias("n"))
    sized = pairs.join(counts, "leader")
    small = sized.filter(F.col("n") <= WIDE).select("leader", F.col("member").alias("node")).unionByName(counts.filter(F.col("n") <= WIDE).select("leader", F.col("leader").alias("node")))
    shown = nodes.groupBy("node").agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    groups = small.join(shown, "node").groupBy("leader").applyInArrow(lambda t: near_groups(t, num, den), "leader bigint, member bigint")
    return groups.unionByName(sized.filter(F.col("n") > WIDE).select("leader", "member")).distinct()


def compared(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """leader, member, size, linked, and the sorted symmetric difference for leaders of two members or more.

    Only texts of sets in pairs are read again, one for each set; each sends its shingles to the groups that ask for them.
    """
    counts = pairs.groupBy("leader").agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / SALTED).cast("int")
    many = F.col("n") > 1
    role = lambda salt, leads: F.struct("leader", salt.alias("salt"), F.lit(leads).alias("leads"), many.alias("many"))
    asks = (
        pairs.join(counts, "leader").select(F.col("member").alias("node"), role(F.pmod(F.xxhash64("member"), salts).cast("int"), False).alias("ask"))
        .unionByName(counts.select(F.col("leader").alias("node"), F.explode(F.transform(F.sequence(F.lit(0), salts - 1), lambda s: role(s, True))).alias("ask")))
        .groupBy("node").agg(F.collect_list("ask").alias("asks"))
    )
    one = nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(asks, "node")
    texts = docs.select("doc_id", "text").join(one.hint("shuffle_hash"), "doc_id").select("text", "node", "asks")

    def run(batches):
        for batch in slices(batches, "text"):
            sets = Sets(_bytes(batch.column("text")), words)
            nodes, asks = batch.column("node").to_numpy(), batch.column("asks").to_pylist()
            # A doc_id that has other texts too brings them along; only the one that was meant counts.
            out = [(a["leader"], a["salt"], None if a["leads"] else int(nodes[k]), a["many"], sets.of(k).tobytes()) for k in np.flatnonzero(sets.key == nodes) for a in asks[k]]
            for i in range(0, len(out), 500):
                part = out[i : i + 500]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], k) for j, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()))], names=["leader", "salt", "member", "many", "shingles"])

    def compare(table: pa.Table) -> pa.Table:
        names, blobs = table["member"].to_pylist(), table["shingles"].to_pylist()
        leader, many = table["leader"][0].as_py(), table["many"][0].as_py()
        mine = np.frombuffer(blobs[names.index(None)], np.uint64)
        rows = []
        for name, blob in dict(zip(names, blobs, strict=True)).items():
            if name is None:
                continue
            other = np.frombuffer(blob, np.uint64)
            diff = np.setxor1d(mine, other, assume_unique=True)
            both = (len(mine) + len(other) - len(diff)) // 2
            rows.append((leader, name, len(other), bool(both * den >= num * (both + len(diff))), diff.tobytes() if many else None))
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate((("leader", pa.int64()), ("member", pa.int64()), ("size", pa.int64()), ("linked", pa.bool_()), ("diff", pa.binary())))})

    sent = texts.mapInArrow(run, "leader bigint, salt int, member bigint, many boolean, shingles binary")
    return sent.groupBy("leader", "salt").applyInArrow(compare, "leader bigint, member bigint, size bigint, linked boolean, diff binary")


def links_beside(table: pa.Table, num: int, den: int) -> pa.Table:
    """Links between members of one leader of which one at least isn't linked with the leader itself.

    With X and Y the differences of two members from the leader, the members differ by |X| + |Y| - 2 |X and Y|
    shingles. A member of n shingles that isn't linked with the leader shares |X| - n (den - num) / num of them
    at least, and one at least, with a member that it is linked with; so the rarest ones of X, one more than
    may be missing, lead to all of them. What is known to be in one component is not compared again: each
    shingle remembers which of its members lie outside the component that looked last.
    """
    member, size, linked = table["member"].to_numpy(), table["size"].to_numpy(), np.array(table["linked"].to_pylist(), bool)
    diffs = [np.frombuffer(x, np.uint64) for x in table["diff"].to_pylist()]
    long = np.array([len(x) for x in diffs], np.int64)
    offset = np.concatenate([[0], np.cumsum(long)])
    flat, code = np.unique(np.concatenate([np.zeros(0, np.uint64), *diffs]), return_inverse=True)
    posting = np.repeat(np.arange(len(diffs)), long)[np.argsort(code, kind="stable")]
    often = np.bincount(code, minlength=len(flat))
    ends = np.concatenate([[0], np.cumsum(often)])
    parent = np.arange(len(diffs))
    if linked.any():
        parent[linked] = np.flatnonzero(linked)[0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def roots(which: np.ndarray) -> np.ndarray:
        up = parent[which]
        while (parent[up] != up).any():
            up = parent[up]
        parent[which] = up
        return up

    outside: dict[int, tuple[int, np.ndarray]] = {}
    out = []
    for x in np.flatnonzero(~linked):
        own = code[offset[x] : offset[x + 1]]
        spare = int(size[x]) * (den - num) // num
        own = own[np.argsort(often[own], kind="stable")][: spare + 1]
        here, near = root(int(x)), []
        for e in own[often[own] > 1].tolist():
            was, rest = outside.get(e, (-1, None))
            if was < 0 or root(was) != here:
                rest = posting[ends[e] : ends[e + 1]]
            rest = rest[roots(rest) != here] if len(rest) else rest
            outside[e] = (here, rest)
            near.append(rest)
        near = np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)
        if not len(near):
            continue
        mine = np.zeros(len(flat) + 1, bool) if len(near) > 64 else None
        whole = code[offset[x] : offset[x + 1]]
        at = np.arange(int(long[near].sum())) - np.repeat(np.cumsum(long[near]) - long[near], long[near]) + np.repeat(offset[near], long[near])
        if mine is not None:
            mine[whole] = True
            same = mine[code[at]]
        else:
            same = np.isin(code[at], whole)
        times = np.add.reduceat(same.astype(np.int64), np.cumsum(long[near]) - long[near])
        apart = long[x] + long[near] - 2 * times
        both = (size[x] + size[near] - apart) // 2
        for y in near[both * den >= num * (both + apart)].tolist():
            a, b = root(int(x)), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((member[x], member[y]))
    return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node that links reach) for every node of a link.

    Alternating large-star and small-star steps; every step is written to the shared folder.
    """
    step = Staged()
    edges = step.table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = both.filter("b < a").join(least.filter("m = a"), "a", "left_anti").join(least, "a").select("a", F.col("m").alias("b"))
        large = large.unionByName(kept).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        after = Staged()
        edges = after.table(small, "links")
        step.drop()
        step = after
        n, heads = edges.agg(F.count("*"), F.countDistinct("a")).first()
        if n == heads and edges.select("b").join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) for each document."""
    importable(docs.sparkSession)
    known = docs.select("doc_id", "text")
    plan, passing = Plan(num, den), Staged()
    nodes = stage_table(node_table(known, words), "jaccard-nodes")
    total = nodes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    share = 4 * (den - num) / (den + num) + 0.05
    linked_docs = known.filter(F.col("doc_id").isNotNull())
    full = nodes.filter("doc_id is not null and node is not null")
    first = Staged()
    met = first.table(meetings(linked_docs, words, plan, max(16, math.ceil(total * share / BUCKET))), "jaccard-met")
    stars = first.table(star_pairs(met), "jaccard-stars")
    pairs = passing.table(sketched(stars, full, num, den), "jaccard-pairs")
    first.drop()
    checked = passing.table(compared(linked_docs, full, pairs, words, num, den), "jaccard-checked")
    mixed = checked.groupBy("leader").agg(F.count_if(~F.col("linked")).alias("loose"), F.count("*").alias("n")).filter("loose > 0 and n > 1").select("leader")
    beside = checked.join(mixed, "leader", "left_semi").groupBy("leader").applyInArrow(lambda t: links_beside(t, num, den), "a bigint, b bigint")
    links = passing.table(checked.filter("linked").select(F.col("leader").alias("a"), F.col("member").alias("b")).unionByName(beside), "jaccard-links")
    roots = components(links)
    own = full.groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = stage_table(placed.join(least, "root").select("node", "component_id"), "jaccard-found")
    passing.drop()
    return nodes.drop("sketch").join(found, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, all columns, without the documents that aren't the first (by doc_id) of their component."""
    placed = jaccard_components(docs, words, num, den)
    name = fresh(docs, "_gone")
    gone = placed.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(name), "left_anti")
