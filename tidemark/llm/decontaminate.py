"""Benchmark decontamination: BM25 over test items with block-max pruning.

The index is built from the test items (a stated query set) in shards of at most SHARD
items, one after another on the driver; SHARDS of them make up what an executor holds
for one pass over the documents. Document frequencies, the mean length and the longest item
are those of the whole benchmark, so scores and passages don't depend on the shards. A shard has the postings of each term, sorted by item,
and the highest impact of each block of BLOCK items that the term occurs in. Every document
is cut into passages of twice the longest item, one longest item apart, so any copy of an
item lies whole in one passage. Each passage is a query of block-max WAND: terms go through their
postings side by side, pivots and blocks that cannot reach their lowest threshold are passed
over, and the rest is scored exactly. Sums are of double precision, and thresholds lie below them
by more than their rounding. An item's threshold is a lower bound of the score of any passage that the
verification can accept, so retrieval loses no pair. Passages with too few runs of GRAM words
whose neighbours are neighbours in an item are left out before. Each retrieved pair is
then verified:
it is a leak if at least OVERLAP of the word 5-grams of the whole item or of its
question (all words but the last quarter) lie in the passage. The share of its
answer (that quarter) grades it: `kind` is "whole" if the question or the item and
OVERLAP of the answer are there, else "question".

Words are lower-cased runs of letters, digits and underscores. Null texts count
as empty; an item without words matches nothing; items with fewer than five
words count as one short gram. Repeated documents or items give their own pairs.
Empty tables give empty results. Other columns pass through.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, importable, map_text

K1, B = 1.2, 0.75
OVERLAP = 0.8
GRAM = 5
BLOCK = 64
SHARD = 8192
SHARDS = 8
WORD = re.compile(r"\w+")
FIELDS = "array<struct<item_id: bigint, score: double, overlap: double, question: double, answer: double, kind: string>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("kind", pa.string())]))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + GRAM]) for i in range(max(1, len(words) - GRAM + 1))} if words else set()


def question_of(words: list[str]) -> list[str]:
    return words[: len(words) - len(words) // 4]


def needed(wanted: set) -> int:
    """The least number of the wanted grams that reaches OVERLAP."""
    return math.ceil(OVERLAP * len(wanted) - 1e-9)


def least_score(words: list[str], weight: dict[str, float]) -> float:
    """No more than the weights of the words in any passage that holds OVERLAP of the grams.

    A word is lost only if all grams over it are missing. The search goes over the
    grams from left to right for each number of missing ones; a repeated gram costs
    nothing again and a repeated word counts at its first place only, which both
    make the bound lower, never higher.
    """
    n, size = len(words), min(GRAM, len(words))
    starts = n - size + 1
    spare = len(grams(words)) - needed(grams(words))
    seen_words: set[str] = set()
    w = [0.0 if t in seen_words or seen_words.add(t) else weight[t] for t in words]
    seen: set[tuple[str, ...]] = set()
    # lost[r, c]: most weight lost with c missing grams, the last r of the starts among them (size or more as size).
    lost = np.full((size + 1, spare + 1), -np.inf)
    lost[0] = 0.0
    for s in range(starts):
        gram = tuple(words[s : s + size])
        cost = int(gram not in seen)
        seen.add(gram)
        new = np.full_like(lost, -np.inf)
        new[0] = lost.max(0)
        for r in range(size + 1):
            to = min(r + 1, size)
            # Word s is lost if all starts from s - size + 1, or from the first, to s are missing.
            gain = w[s] if to >= min(size, s + 1) else 0.0
            if s == starts - 1:
                gain += sum(w[p] for p in range(starts, n) if to >= starts - max(0, p - size + 1))
            moved = lost[r, : spare + 1 - cost] + gain
            new[to, cost:] = np.maximum(new[to, cost:], moved)
        lost = new
    return sum(w) - float(lost.max())


class Index:
    """Impacts of one shard of items."""

    def __init__(self, items: list[tuple[int, list[str]]], idf: dict[str, float], mean: float, longest: int) -> None:
        self.longest, self.width, self._lists = longest, BLOCK, None
        # Items of one vocabulary and of like scores share a block, which keeps its bounds tight.
        weights = lambda w: {t: idf[t] * w.count(t) * (K1 + 1) / (w.count(t) + K1 * (1 - B + B * len(w) / mean)) for t in set(w)}
        common = lambda w: min(set(w), key=lambda t: (idf[t], t))
        rows = sorted(((common(w), sum(own.values()), i, w, own) for i, w in items for own in (weights(w),)), key=lambda r: r[:3])
        self.items = items = [(i, w) for _, _, i, w, _ in rows]
        self.terms = {t: i for i, t in enumerate(sorted({t for _, w in items for t in w}))}
        n, self.blocks = len(self.terms), (len(items) + BLOCK - 1) // BLOCK
        posts = sorted((self.terms[t], j, x) for j, r in enumerate(rows) for t, x in r[4].items())
        term, self.item, self.impact = (np.array([p[i] for p in posts], kind) for i, kind in enumerate((np.int64, np.int64, float)))
        code = term * self.blocks + self.item // BLOCK
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        #: Of each term's blocks: number, first posting, end of postings, highest impact; a term's blocks start at `of_term`.
        self.block, self.first, self.last = self.item[begin] // BLOCK, begin, np.append(begin[1:], len(code))
        self.highest = np.maximum.reduceat(self.impact, begin)
        self.of_term = np.searchsorted(term[begin], np.arange(n + 2))
        self.top = np.append(np.maximum.reduceat(self.impact, np.searchsorted(term, np.arange(n))), 0.0)
        least = np.array([min(least_score(r[3], r[4]), least_score(question_of(r[3]), r[4])) for r in rows])
        self.goal = least * (1 - 1e-9) - 1e-9
        self.block_goal = np.minimum.reduceat(self.goal, np.arange(0, len(items), BLOCK))
        self.whole = [grams(w) for _, w in items]
        self.ask = [grams(question_of(w)) for _, w in items]
        self.answer = [grams(w[len(w) - len(w) // 4 :]) for _, w in items]
        deciding = [*self.whole, *self.ask]
        #: Every deciding gram has so many words at least, and every leak so many of them.
        self.shortest, self.fewest = min(len(g) for x in deciding for g in x), min(map(needed, deciding))
        self.pairs = np.array(sorted({self.terms[a] * (n + 1) + self.terms[b] for _, w in items for a, b in zip(w, w[1:], strict=False)}), np.int64)

    def possible(self, ids: np.ndarray) -> np.ndarray:
        """Before each word: how many runs of `shortest` words began that an item may have."""
        none, run = len(self.terms), self.shortest
        if run == 1:
            can = ids != none
        else:
            code = ids[:-1] * (none + 1) + ids[1:]
            near = self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code
            total = np.concatenate([[0], np.cumsum(near)])
            can = total[run - 1 :] - total[: 1 - run] == run - 1 if len(total) >= run else np.zeros(0, bool)
        return np.pad(np.concatenate([[0], np.cumsum(can)]), (0, len(ids) - len(can)), "edge")

    def lists(self) -> tuple:
        """The postings as lists, made once in a process; broadcasts carry the arrays alone."""
        if self._lists is None:
            self._lists = tuple(x.tolist() for x in (self.item, self.impact, self.block, self.first, self.last, self.highest, self.of_term, self.top, self.goal, self.block_goal))
        return self._lists

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lists": None}

    def retrieved(self, terms: np.ndarray, tally: Counter | None = None) -> list[tuple[int, float]]:
        """Items that reach their thresholds, with their scores, by block-max WAND.

        Terms are cursors in their postings, in the order of the items that they stand at. The pivot is the first item that
        the highest impacts of the terms up to it could bring to the lowest threshold of all. If the highest impacts in
        the pivot's block cannot reach the block's lowest threshold, all these terms go on to the end of the block, or to
        the next term's item; else they go on to the pivot, and it is scored when all have met there. tally counts the
        postings that were scored and those that were passed over.
        """
        item, impact, block, first, last, highest, of_term, top, goal, block_goal = self.lists()
        # Item, highest impact, posting, end of postings, block, end of blocks.
        open_ = [[item[first[of_term[t]]], top[t], first[of_term[t]], last[of_term[t + 1] - 1], of_term[t], of_term[t + 1]] for t in terms.tolist() if of_term[t] < of_term[t + 1]]
        out, scored, passed, lowest = [], 0, 0, min(block_goal)
        while True:
            open_.sort()
            bound, pivot = 0.0, 0
            for c in open_:
                bound += c[1]
                if bound >= lowest:
                    break
                pivot += 1
            else:
                break
            at = open_[pivot][0]
            while pivot + 1 < len(open_) and open_[pivot + 1][0] == at:
                pivot += 1
            here, high = at // self.width, 0.0
            for c in open_[: pivot + 1]:
                if block[c[4]] < here:
                    c[4] = bisect_left(block, here, c[4], c[5])
                if c[4] < c[5] and block[c[4]] == here:
                    high += highest[c[4]]
            if high >= block_goal[here] and open_[0][0] == at:
                score = math.fsum(impact[c[2]] for c in open_[: pivot + 1])
                if score >= goal[at]:
                    out.append((at, score))
                scored += pivot + 1
                to = at + 1
            else:
                to = at if high >= block_goal[here] else min((here + 1) * self.width, open_[pivot + 1][0] if pivot + 1 < len(open_) else 1 << 62)
            for c in open_[: pivot + 1]:
                if c[0] < to:
                    p = c[2] + 1
                    if p < c[3] and item[p] < to:
                        p = bisect_left(item, to, p, c[3])
                    passed += p - c[2]
                    c[2] = p
                    c[0] = item[p] if p < c[3] else -1
            open_ = [c for c in open_ if c[0] >= 0 and c[4] < c[5]]
        if tally is not None:
            tally.update(scored=scored, passed=passed - scored)
        return out

    def search(self, words: list[str]) -> list[dict]:
        """Verified pairs of one document, the best passage for each item."""
        get, none = self.terms.get, len(self.terms)
        ids = np.array([get(w, none) for w in words], np.int64)
        known = np.flatnonzero(ids != none)
        if not len(known):
            return []
        step = self.longest
        count = max(1, -(-len(words) // step) - 1)
        began = self.possible(ids)
        at = np.arange(count) * step
        end = np.minimum(at + 2 * step, len(words))
        hopeful = began[np.maximum(end - self.shortest + 1, at)] - began[at] >= self.fewest
        if not hopeful.any():
            return []
        bound = np.concatenate([[0.0], np.cumsum(self.top[ids], dtype=float)])
        hopeful = np.flatnonzero(hopeful & (bound[end] - bound[at] >= self.block_goal.min()))
        best: dict[int, dict] = {}
        for p in hopeful:
            lo, hi = p * step, (p + 2) * step
            terms = np.array(list(set(ids[lo:hi].tolist()) - {none}), np.int64)
            passage = grams(words[lo:hi])
            for i, score in self.retrieved(terms):
                have = passage if GRAM <= len(self.items[i][1]) else None
                share = lambda g: _share(g, have, words[lo:hi])  # noqa: B023, E731
                overlap, question = share(self.whole[i]), share(self.ask[i])
                if max(overlap, question) >= OVERLAP and (i not in best or (overlap, question) > (best[i]["overlap"], best[i]["question"])):
                    answer = share(self.answer[i])
                    best[i] = {"item_id": self.items[i][0], "score": score, "overlap": overlap, "question": question, "answer": answer, "kind": "whole" if answer >= OVERLAP or not self.answer[i] else "question"}
        return [best[i] for i in sorted(best)]


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from begin to end, range after range."""
    long = end - begin
    return np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long) + np.repeat(begin, long)


def _share(wanted: set, have: set | None, words: list[str]) -> float:
    """Share of the wanted grams in a passage; grams shorter than GRAM are looked up as runs of words."""
    if not wanted:
        return 0.0
    if have is not None and all(len(g) == GRAM for g in wanted):
        return len(wanted & have) / len(wanted)
    runs = {n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} for n in {len(g) for g in wanted}}
    return sum(g in runs[len(g)] for g in wanted) / len(wanted)


def index_of(items: list[tuple[int, list[str]]], known: Statistics | None = None) -> Index:
    """The index of one shard, with the statistics of the whole benchmark (of these items alone if none are given)."""
    known = known or statistics(items)
    return Index(items, known.idf(items), known.total / known.items, known.longest)


@dataclass
class Statistics:
    """Of all test items: how many have words, their words, the longest, and in how many each word of a shard stands."""

    items: int
    total: int
    longest: int
    df: dict[str, int]

    def idf(self, items: list[tuple[int, list[str]]]) -> dict[str, float]:
        return {t: float(np.log(1 + (self.items - self.df[t] + 0.5) / (self.df[t] + 0.5))) for _, w in items for t in set(w)}


def statistics(items: list[tuple[int, list[str]]]) -> Statistics:
    df: dict[str, int] = {}
    for _, w in items:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    return Statistics(len(items), sum(len(w) for _, w in items), max(len(w) for _, w in items), df)


def build(benchmark: DataFrame) -> Iterator[Index]:
    """The shards of the index; the driver holds the items of one shard at a time, each word with its count over all items."""
    importable(benchmark.sparkSession)

    def split(batches):
        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), pa.array(words, pa.list_(pa.string()))], names=["item_id", "text", "words"])

    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null").mapInArrow(split, "item_id bigint, text string, words array<string>").filter(F.size("words") > 0)
    size = rows.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("total"), F.max(F.size("words")).alias("longest")).first()
    pairs = rows.withColumn("row", F.monotonically_increasing_id())
    df = rows.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    counted = pairs.select("row", F.explode(F.array_distinct("words")).alias("word")).join(df, "word").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "df"))).alias("df"))
    part: list[tuple[int, list[str]]] = []
    known = Statistics(size.n, size.total or 0, size.longest or 0, {})
    for r in pairs.join(counted, "row").select("item_id", "text", "words", "df").orderBy("item_id", "text").toLocalIterator():
        part.append((r.item_id, r.words))
        known.df.update(r.df)
        if len(part) == SHARD:
            yield index_of(part, known)
            part, known.df = [], {}
    if part:
        yield index_of(part, known)


def with_leaks(docs: DataFrame, benchmark: DataFrame, into: str = "_leaks") -> DataFrame:
    """docs, all rows and columns, with the verified pairs in the array column `into`; one pass for each SHARDS shards.

    A column of docs that is named `into` is replaced.
    """
    docs = docs.drop(into)
    held = [docs.sparkSession.sparkContext.broadcast(index) for index in build(benchmark)]
    if not held:
        return docs.withColumn(into, F.array().cast(FIELDS))
    names = []
    for k in range(0, len(held), SHARDS):

        def function(texts: list[str], part=held[k : k + SHARDS]) -> pa.Array:
            found = []
            for text in texts:
                words = words_of(text)
                found.append([leak for shard in part for leak in shard.value.search(words)])
            return pa.array(found, _ARROW)

        names.append(fresh(docs, into))
        docs = map_text(docs, function, FIELDS, names[-1])
    return docs.withColumn(names[0], F.concat(*names)).drop(*names[1:]).withColumnRenamed(names[0], into)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and test item that it holds."""
    return with_leaks(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("_leaks").alias("l")).select("doc_id", "l.*")
