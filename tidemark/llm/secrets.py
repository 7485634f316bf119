"""Secret scans: fixed patterns and a battery of randomness tests.

Beside the three base patterns, each unbroken run of 20 or more characters of
common encodings is a candidate, unless it overlaps a base span or has digits only. Its
encoding (hex, base 32, upper or lower letters with digits, base 62, base 64) is inferred
from its characters. Three tests ask whether its symbols could be uniform draws
from that alphabet: chi-squared over the alphabet, runs above and below the
middle, and the lag-1 serial correlation; Fisher's method joins their p-values to one
figure. Random keys have any value from 0 to 1 there, glued words, names and paths values near 0.

How near depends on the length, so the false discoveries are controlled in each band of
length by itself. The same battery runs over text that is no secret: in each
document a passage, picked by a hash of the text, gives its words, glued together in
one of four ways (small letters, capitalised with numbers, with joining signs, capitals),
once for each band, beside PRIOR strings a band of letters drawn by their frequencies. The
share of those of its own encoding that look at least as random is a candidate's p-value (of
all in the band for an encoding of which FEW or less were seen), and the Benjamini-Hochberg
rule at FDR over all candidates of the corpus in that band decides which ones are reported.

Null texts count as empty: no spans. Rows with repeated or null doc_id are
scanned by themselves. Empty tables give empty results. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, map_text, stage_table

# The base patterns and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Ends of the length bands; runs of the last end or more are the last band.
BANDS = (24, 32, 48, 96)
FDR = 0.01
#: The joint p-values are counted in bins of a twentieth of a decade, the last of which is open.
BINS, LAST_BIN = 20, 400
#: Drawn strings a band, beside those from the corpus.
PRIOR = 8000
FEW = 100
EXPECTED = 5
#: Letters and how often they occur in a hundred of English text.
FREQUENT = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (12.7, 9.1, 8.2, 7.5, 7.0, 6.7, 6.3, 6.1, 6.0, 4.3, 4.0, 2.8, 2.8, 2.4, 2.4, 2.2, 2.0, 2.0, 1.9, 1.5, 1.0, 0.8, 0.2, 0.2, 0.1, 0.1), strict=True))
PLAIN = re.compile(r"[A-Za-z]{2,}")

ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("any", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Place of each symbol of an alphabet in the order of how often text has it.
_RANKS = {name: np.argsort(sorted(range(len(a)), key=lambda i: (-FREQUENT.get(a[i], FREQUENT.get(a[i].lower(), 0.5) / 50), i))) for name, a in ALPHABETS}  # noqa: B023
_CODES = {name: i for i, (name, _) in enumerate(ALPHABETS)}
_VALUES = [(name, {c: i for i, c in enumerate(a)}, frozenset(a)) for name, a in ALPHABETS]

FIELDS = "struct<n_assign: bigint, n_access: bigint, n_hex: bigint, base_sha256: string, base: array<struct<start: bigint, kind: int, end: bigint>>, found: array<struct<start: bigint, end: bigint, band: int, code: int, p_bin: int>>, plain: array<struct<band: int, code: int, p_bin: int>>>"


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer_encoding(run: str) -> tuple[str, dict[str, int]]:
    """The narrowest alphabet that has all characters of the run; padding doesn't count."""
    have = set(run)
    for name, values, chars in _VALUES:
        if have <= chars:
            return name, values
    raise ValueError("not a candidate")


def battery(run: str) -> dict[str, float]:
    """p-values of the three tests under uniform draws, and Fisher's joint one.

    The symbols make up cells of equal size, each of which expects EXPECTED of the run at least: the most frequent
    ones of text first, so that text fills the first cells.
    """
    name, values = infer_encoding(run)
    v = np.array([values[c] for c in run], dtype=float)
    n, k = len(v), len(values)
    cells = max(2, min(k, n // EXPECTED))
    ends = np.arange(cells + 1) * k // cells
    counts = np.bincount(np.searchsorted(ends, _RANKS[name][v.astype(int)], "right") - 1, minlength=cells)
    mean = np.diff(ends) * n / k
    x2, free = float(((counts - mean) ** 2 / mean).sum()), cells - 1
    # Wilson and Hilferty's cube root of a chi-squared variable is nearly normal.
    y = max(1e-9, x2 / free) ** (1 / 3)
    chi = _normal_tail((y - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    high = v >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    runs = 0.0
    if a and b:
        r = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 2 * _normal_tail(abs(r - mean) / math.sqrt(var)) if var > 0 else 1.0
    d = v - v.mean()
    spread = float((d * d).sum())
    r1 = float((d[1:] * d[:-1]).sum()) / spread if spread else 1.0
    serial = 2 * _normal_tail(abs(r1 + 1 / n) * math.sqrt(n))
    ps = [min(1.0, max(p, 1e-300)) for p in (chi, runs, serial)]
    h = -sum(map(math.log, ps))
    # Six degrees of freedom have a closed upper tail.
    joint = math.exp(-h) * (1 + h + h * h / 2)
    return {"chi": ps[0], "runs": ps[1], "serial": ps[2], "joint": joint}


def p_bin(run: str) -> int:
    return min(LAST_BIN, int(-math.log10(max(battery(run)["joint"], 1e-300)) * BINS))


def cell(run: str) -> dict[str, int]:
    """Length band, number of the encoding and bin of a run."""
    return {"band": band_of(len(run)), "code": _CODES[infer_encoding(run)[0]], "p_bin": p_bin(run)}


def band_of(n: int) -> int:
    return sum(n >= x for x in BANDS)


def glued(words: list[str], way: int, n: int, number: int) -> str:
    """The first n characters of words written as one, or less if they don't suffice."""
    if way == 2:
        return "-_/"[number % 3].join(words).lower()[:n]
    numbered = [w.capitalize() + (str(number % 97) if k % 3 == 2 and (way == 1 or number % 2) else "") for k, w in enumerate(words)]
    run = "".join(numbered)[:n]
    return run if way == 1 else run.lower() if way == 0 else run.upper()


def _lengths(number: int) -> list[int]:
    """A length in each band."""
    ends = (20, *BANDS, 2 * BANDS[-1])
    return [a + number % (b - a) for a, b in zip(ends, ends[1:], strict=False)]


def plain_bins(text: str) -> list[dict]:
    """Bins of the document's own glued words, one for each band that a passage of it can fill."""
    number = zlib.crc32(text.encode("utf-8", "replace"))
    at = number % max(1, len(text) - 600)
    words = PLAIN.findall(text[at : at + 800])
    out = []
    for band, n in enumerate(_lengths(number >> 3)):
        run = glued(words, (number + band) % 4, n, number >> 5)
        if len(run) == n:
            out.append(cell(run))
    return out


@lru_cache
def drawn_bins(count: int = PRIOR, seed: int = 1) -> dict[tuple[int, int, int], int]:
    """Bins of strings of words whose letters are drawn by their frequencies: the least that any corpus is held against."""
    rng, out = random.Random(seed), {}
    letters, weights = list(FREQUENT), list(FREQUENT.values())
    for k in range(count):
        number = rng.randrange(1 << 30)
        text = rng.choices(letters, weights, k=2 * BANDS[-1])
        words = ["".join(text[i : i + 5]) for i in range(0, len(text), 5)]
        for n in _lengths(number):
            key = tuple(cell(glued(words, k % 4, n, number)).values())
            out[key] = out.get(key, 0) + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Runs that overlap no base span and have more than digits, each with its band and bin."""
    starts, reach = [a for a, _, _ in base], []
    for _, _, b in base:
        reach.append(max(b, reach[-1] if reach else 0))
    out = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        run = m[0].rstrip("=")
        before = bisect_left(starts, e)  # base spans that begin before the run's end
        if run.isdigit() or (before and reach[before - 1] > s):
            continue
        out.append({"start": s, "end": e, **cell(run)})
    return out


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(texts: list[str]) -> pa.Array:
    rows = []
    for text in texts:
        base = base_spans(text)
        n = [sum(k == i for _, k, _ in base) for i in range(3)]
        rows.append({"n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(named(base).encode()).hexdigest(), "base": [{"start": s, "kind": k, "end": e} for s, k, e in base], "found": candidates(text, base), "plain": plain_bins(text)})
    kind = pa.struct([
        ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()),
        ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
        ("found", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("band", pa.int32()), ("code", pa.int32()), ("p_bin", pa.int32())]))),
        ("plain", pa.list_(pa.struct([("band", pa.int32()), ("code", pa.int32()), ("p_bin", pa.int32())]))),
    ])
    return pa.array(rows, kind)


def scan(docs: DataFrame, into: str = "_secrets") -> DataFrame:
    """docs with base spans and tested candidates in the struct column `into`."""
    return map_text(docs, _scan, FIELDS, into)


def discovery_bins(scanned: DataFrame, into: str = "_secrets", fdr: float = FDR) -> dict[tuple[int, int], int]:
    """For each length band and encoding, the last bin that the Benjamini-Hochberg rule reports; lower bins are more random.

    Only counts by band, encoding and bin come to the driver.
    """
    cells = lambda name, asked: F.transform(f"{into}.{name}", lambda f: F.struct(f["band"].alias("band"), f["code"].alias("code"), f["p_bin"].alias("p_bin"), F.lit(asked).alias("asked")))
    rows = scanned.select(F.explode(F.concat(cells("found", True), cells("plain", False))).alias("f")).groupBy("f.band", "f.code", "f.p_bin", "f.asked").agg(F.count("*").alias("n")).collect()
    asked, plain = {}, dict(drawn_bins())
    for r in rows:
        of, key = asked if r.asked else plain, (r.band, r.code, r.p_bin)
        of[key] = of.get(key, 0) + r.n
    return reported_bins(asked, plain, fdr)


def reported_bins(asked: dict[tuple[int, int, int], int], plain: dict[tuple[int, int, int], int], fdr: float) -> dict[tuple[int, int], int]:
    """asked and plain: counts of candidates and of glued words by band, encoding and bin."""
    out = {}
    for band in {b for b, _, _ in asked}:
        values = []  # p-value, encoding, bin and number of candidates
        for code in {c for b, c, _ in asked if b == band}:
            null = {k: n for (b, c, k), n in plain.items() if b == band and c == code}
            if sum(null.values()) < FEW:
                null = {}
                for (b, _, k), n in plain.items():
                    if b == band:
                        null[k] = null.get(k, 0) + n
            total, false = sum(null.values()), 0
            for k in range(LAST_BIN + 1):
                false += null.get(k, 0)
                if n := asked.get((band, code, k)):
                    values.append(((1 + false) / (1 + total), code, k, n))
        tests, found, cut = sum(v[3] for v in values), 0, -1.0
        for p, _, _, n in sorted(values):
            found += n
            if p * tests <= fdr * found:
                cut = p
        for p, code, k, _ in values:
            if p <= cut:
                out[band, code] = max(k, out.get((band, code), -1))
    return out


def picked(last: dict[tuple[int, int], int], into: str = "_secrets"):
    """Column: all spans to report, sorted, as structs of start, kind and end."""
    passes = lambda f: F.coalesce(*[F.when((f["band"] == b) & (f["code"] == c) & (f["p_bin"] <= p), F.lit(True)) for (b, c), p in last.items()], F.lit(False))
    more = F.transform(F.filter(f"{into}.found", passes), lambda f: F.struct(f["start"].alias("start"), F.lit(3).alias("kind"), f["end"].alias("end")))
    return F.sort_array(F.concat(F.col(f"{into}.base"), more))


def secret_report(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row for each document; the texts are read once."""
    scanned = stage_table(scan(docs.select("doc_id", "text")).drop("text"), "secrets")
    last = discovery_bins(scanned, fdr=fdr)
    name = lambda s: F.concat_ws(":", F.array(*[F.lit(k) for k in KINDS])[s["kind"]], s["start"], s["end"])
    spans = F.array_join(F.transform(picked(last), name), ",")
    return scanned.select("doc_id", "_secrets.n_assign", "_secrets.n_access", "_secrets.n_hex", "_secrets.base_sha256", spans.alias("spans"))


def redact(docs: DataFrame, fdr: float = FDR, mark: str = "[secret]") -> DataFrame:
    """docs, all rows and columns, with each reported span replaced by `mark`; overlapping spans become one.

    The texts are scanned twice, first for the counts of the corpus, rather than staged.
    """
    last = discovery_bins(scan(docs.select("text")), fdr=fdr)
    into = fresh(docs, "_clean")

    def clean(texts: list[str]) -> pa.Array:
        out = []
        for text in texts:
            base = base_spans(text)
            spans = [(s, e) for s, _, e in base] + [(f["start"], f["end"]) for f in candidates(text, base) if f["p_bin"] <= last.get((f["band"], f["code"]), -1)]
            parts, at = [], 0
            for s, e in sorted(spans):
                if s >= at:
                    parts += [text[at:s], mark]
                at = max(at, e)
            out.append({"text": "".join([*parts, text[at:]]), "hits": len(spans)})
        return pa.array(out, pa.struct([("text", pa.string()), ("hits", pa.int64())]))

    cleaned = map_text(docs, clean, "struct<text: string, hits: bigint>", into)
    # A text without spans, or a null one, stays as it was.
    return cleaned.withColumn("text", F.when(F.col(f"{into}.hits") > 0, F.col(f"{into}.text")).otherwise(F.col("text"))).drop(into)
