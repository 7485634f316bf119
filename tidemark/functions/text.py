"""Tokenizers, counters and normal forms as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide results.
SCORING = "[a-z']+"
CONTRAST = "[a-z]{3,}"
HEADER = r"THE\s+ECONOMIST\s+[A-Z]+\s+\d{1,2},?\s+\d{4}"
LABEL = r"\bAdvertisement\b"
LEGAL_SUFFIXES = ["the", "limited", "ltd", "plc", "inc", "incorporated", "co", "company", "corporation", "corp", "sa", "ag", "nv", "llc", "gmbh", "spa", "bv", "ab", "as", "and"]


def scoring_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(SCORING), F.lit(0))


def contrast_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(CONTRAST), F.lit(0))


def topic_tokens(text: Column) -> Column:
    """Whole words of three or more ASCII letters: runs of word characters that match as a whole."""
    return F.transform(F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-zA-Z]{3,}$")), F.lower)


def letter_tokens(text: Column) -> Column:
    """Runs of letters of any script, in small letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def _class(*parts: str) -> str:
    return f"[{''.join(parts)}]"


# Classes of the word boundary rules (Unicode annex 29). Letters are those that aren't set without spaces.
AH_LETTER = r"[\p{L}\p{Nl}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]]"
KATAKANA, JOINER = r"\p{IsKatakana}", r"[\p{Pc}\u202F]"
FOLLOWING = r"[\p{M}\p{Cf}]*"
MID_LETTER = ":\u00B7\u0387\u055F\u05F4\u2027\uFE13\uFE55\uFF1A"
MID_BOTH = ".'\u2018\u2019\u2024\uFE52\uFF07\uFF0E"
MID_NUMBER = ",;\u037E\u0589\u060C\u060D\u066C\u07F8\u2044\uFE10\uFE14\uFE50\uFE54\uFF0C\uFF1B"
ALONE = r"[\p{IsHan}\p{IsHiragana}]"


def word_pattern() -> str:
    """Words between boundaries: letters that a mark may join to letters, digits to digits, and joiners with both.

    Marks of extension and format characters go with what stands before them. Ideographs and hiragana stand alone.
    """
    letter, digit, katakana, joiner = (f"(?:{c}{FOLLOWING})" for c in (AH_LETTER, r"\p{Nd}", KATAKANA, JOINER))
    between = lambda *marks: f"{_class(*marks)}{FOLLOWING}"
    parts = [f"{letter}(?:{between(MID_LETTER, MID_BOTH)}{letter})*", f"{digit}(?:{between(MID_NUMBER, MID_BOTH)}{digit})*", katakana, joiner]
    return f"(?:{'|'.join(parts)})+|{ALONE}{FOLLOWING}"


def boundary_tokens(text: Column) -> Column:
    """Words by the boundary rules in small letters, without those that hold no letter (numbers, joiners)."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(word_pattern()), F.lit(0)), lambda w: w.rlike(r"\p{L}"))


def as_boolean(text: Column) -> Column:
    """true and false, 1 and 0, yes and no in any case; null for all else."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1", "yes"), F.lit(True)).when(low.isin("false", "0", "no"), F.lit(False))


def excerpt(text: Column, pattern: str, around: int = 150) -> Column:
    """The first match with `around` characters on each side; null without one.

    The match is found first, by the pattern alone; the search with what stands around begins `around` characters
    ahead of it, where it succeeds at once.
    """
    ahead = F.split(text, rf"(?is)(?:{pattern})", 2)
    near = F.substring(text, F.greatest(F.char_length(ahead[0]) - around, F.lit(0)) + 1, F.char_length(text))
    found = F.regexp_extract(near, rf"(?is).{{0,{around}}}(?:{pattern}).{{0,{around}}}", 0)
    return F.nullif(F.when(F.size(ahead) > 1, found), F.lit(""))


def excerpt_from(text: Column, pattern: str, before: int = 150, length: int = 600) -> Column:
    """`length` characters from `before` ahead of the first match on; null without one."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(length)))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def has_words(text: Column, least: int) -> Column:
    """Whether there are `least` words (one or more); the search ends with the last of these."""
    return text.rlike(rf"^\s*+(?:\S++\s++){{{least - 1}}}\S")


def normalized(text: Column) -> Column:
    """Small letters, words joined over a hyphen and a break, single spaces."""
    # Spaces that stand alone are left as they are, so only other white space costs a replacement.
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"-\s+", ""), r"\s{2,}|[\t\n\x0B\f\r]", " ")


_PIECE = re.compile(r"(?P<group>\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\]|\\[A-Za-z])(?:[?*+]|\{[^}]*\})?|(?:\\)?(?P<char>[^\\])(?P<times>[?*+]|\{[^}]*\})?|\\$")


def literal_part(pattern: str) -> str:
    """The longest text that every match of a pattern without an outer alternative holds; empty if none is sure."""
    runs, now = [], ""
    for m in _PIECE.finditer(pattern):
        char, sure = m["char"], not m["times"]
        escaped = m[0].startswith("\\")
        if char is None or (not escaped and char in "|^$."):
            if char == "|":
                return ""
            runs.append(now)
            now = ""
        elif sure:
            now += char
        else:
            runs.append(now)
            now = ""
    return max([*runs, now], key=len)


def any_of(text: Column, patterns: list[str], prefix: str = "") -> Column:
    """Whether any pattern matches. Texts without the fixed parts of the patterns are passed over without a search."""
    found = text.rlike(prefix + "|".join(f"(?:{p})" for p in patterns))
    parts = sorted({literal_part(p) for p in patterns})
    if prefix or min(map(len, parts), default=0) < 3:
        return found
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts]) & found


def brand_key(brand: Column) -> Column:
    """Name without signs and legal suffixes; the trimmed name where nothing is left."""
    plain = F.regexp_replace(F.replace(F.lower(brand), F.lit("&"), F.lit(" and ")), "[^a-z0-9 ]+", " ")
    words = F.filter(F.split(plain, " "), lambda w: (w != "") & ~w.isin(LEGAL_SUFFIXES))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.trim(F.lower(brand)))


def first_rule(key: Column, rules: list[tuple[str, list[str]]], other: str = "Other") -> Column:
    """Name of the first rule with a keyword in key: whole words, or beginnings of words for keywords that end in *."""
    rule = lambda words: "|".join(rf"\b{w[:-1]}" if w.endswith("*") else rf"\b{w}\b" for w in words)
    first, *rest = rules
    return reduce(lambda c, r: c.when(key.rlike(rule(r[1])), r[0]), rest, F.when(key.rlike(rule(first[1])), first[0])).otherwise(other)
