"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tidemark.llm.common import LOWER, UPPER
from tidemark.llm.quality_rules import ALPHA, BANDS, DELTA, GRID, MEASURES, REFERENCE, SHARES, SLACK, least_trials

_SPACE = r"[^\x20\x09-\x0D]"
_ERROR, _LEAST = DELTA / (len(BANDS) + 1), least_trials()


def _chain() -> str:
    """Strata of the bands 0 to len(BANDS), one select inside another."""
    out = "SELECT " + ", ".join(f"count(*) FILTER (band = {b} AND NOT reference) AS n{b}" for b in range(len(BANDS) + 1)) + " FROM known"
    out = f"SELECT *, 0 AS t0, n0 AS a0 FROM ({out})"
    for b in range(1, len(BANDS) + 1):
        out = f"SELECT *, t{b - 1} + CAST(a{b - 1} >= {_LEAST} AS INTEGER) AS t{b}, CASE WHEN a{b - 1} >= {_LEAST} THEN n{b} ELSE a{b - 1} + n{b} END AS a{b} FROM ({out})"
    last = f"CASE WHEN a{len(BANDS)} >= {_LEAST} THEN t{len(BANDS)} ELSE greatest(t{len(BANDS)} - 1, 0) END"
    return f"SELECT unnest([{', '.join(map(str, range(len(BANDS) + 1)))}]) AS band, unnest([{', '.join(f'least(t{b}, {last})' for b in range(len(BANDS) + 1))}]) AS stratum FROM ({out})"


_GRID = ", ".join(f"{g:e}" for g in GRID)
_STEP = lambda x: f"len(list_filter([{_GRID}], lambda g: g < {x}))"
_LEVELS = ", ".join([f"({i}, 0.0, {s})" for i, s in enumerate(SLACK)] + [f"({len(SLACK) + i}, {r:e}, 0)" for i, r in enumerate(SHARES)])

OP7 = rf"""
WITH d AS (SELECT doc_id, t, w, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(t, '!')) AS n_bangs
  FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS l FROM documents)),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM dup, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
c AS (SELECT d.* EXCLUDE (t, w), coalesce(n, 0) AS n_repeat_words, {" + ".join(f"CAST(n_words >= {b} AS INTEGER)" for b in BANDS)} AS band FROM d LEFT JOIN cov USING (doc_id)),
m AS (SELECT *, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbols, coalesce(n_capitals / nullif(word_chars, 0), 0) AS capitals, coalesce(n_bangs / nullif(word_chars, 0), 0) AS bangs,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_lines, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeats FROM c),
known AS (SELECT doc_id, min(band) AS band, {", ".join(f"max({_STEP(x)}) AS {x}" for x in MEASURES)}, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ({", ".join(f"'{c}'" for c in REFERENCE)}) AS reference
  FROM m WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1) GROUP BY doc_id),
strata AS ({_chain()}),
placed AS (SELECT * FROM known JOIN strata USING (band)),
r AS (SELECT stratum, measure, step, count(*) AS c FROM (UNPIVOT (SELECT stratum, {", ".join(MEASURES)} FROM placed WHERE reference) ON {", ".join(MEASURES)} INTO NAME measure VALUE step) GROUP BY ALL),
h AS (SELECT stratum, measure, j, coalesce(sum(c) FILTER (step > j), 0) AS above, sum(c) AS n FROM r, (SELECT unnest(range(0, {len(GRID) + 1})) AS j) GROUP BY ALL),
path AS (SELECT stratum, level, {", ".join(f"min(j) FILTER (measure = '{x}' AND above <= share * n) + max(slack) AS r_{x}" for x in MEASURES)} FROM h, (VALUES {_LEVELS}) v(level, share, slack) GROUP BY stratum, level),
k AS (SELECT stratum, level, {", ".join(f"r_{x}" for x in MEASURES)}, count(*) AS n, count(*) FILTER ({" OR ".join(f"{x} > r_{x}" for x in MEASURES)}) AS k FROM placed JOIN path USING (stratum) WHERE NOT reference GROUP BY ALL),
ok AS (SELECT * FROM k WHERE k < n * {ALPHA:e} AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA:e}) + (n - j) * ln(1 - {ALPHA:e})))) <= {_ERROR:e}
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY level DESC) = 1),
cuts AS (SELECT band, {", ".join(f"list_extract([{_GRID}], r_{x} + 1) AS cut_{x}" for x in MEASURES)} FROM ok JOIN strata USING (stratum)),
v AS (SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {" OR ".join(f"coalesce({x} > cut_{x}, false)" for x in MEASURES)} AS broken FROM m LEFT JOIN cuts USING (band))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_capitals, n_bangs, band, base_failed, NOT base_failed AND NOT broken AS kept FROM v"""

OP6 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_SPACE}+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a"""

OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 49))) AS k FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, k FROM g JOIN f USING (s) WHERE first < doc_id),
isle AS (SELECT doc_id, k, sum(opens) OVER (PARTITION BY doc_id ORDER BY k) AS isle FROM (SELECT *, CAST(coalesce(k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50, true) AS INTEGER) AS opens FROM hit)),
span AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS z FROM isle GROUP BY doc_id, isle),
gap AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM span),
kept AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS rest FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13 = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERM}')) AS term FROM documents),
s AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM s),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERM}')) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term),
i AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // len))) AS impact FROM p JOIN s USING (doc_id), g),
f AS (SELECT item_id, doc_id, CAST(sum(w * impact) AS BIGINT) AS score FROM q JOIN i USING (term) JOIN w USING (term) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM f WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""



def _way(state: int, letters: str, cost: str) -> str:
    """The way that ends in `state` (from 1) so far, with further letters and cost."""
    return f"{{'c': v[{state}].c + {cost}, 'a': v[{state}].a || {letters}}}"


def _stays(target: str, free: tuple[int, ...], paid: tuple[int, ...]) -> str:
    """Ways to keep or rerole a row to `target`: from states that need no row between, and from those that need one."""
    letter, own = f"CASE WHEN initial = '{target}' THEN 'K' ELSE 'R' END", f"own + CASE WHEN initial = '{target}' THEN 0 ELSE 1 END"
    return ", ".join([_way(q, letter, own) for q in free] + [_way(q, f"'I' || {letter}", f"5 + {own}") for q in paid])


OP12 = rf"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
coded AS (SELECT named.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM named, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM hurt),
seen AS (SELECT *, NOT regexp_matches(text, '{_SPACE}') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM numbered),
faults AS (SELECT *, blank OR again AS forced, CASE WHEN cut THEN 5 ELSE 0 END AS own FROM seen),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT forced) AS truncated,
  count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
dp(conv_id, n, v) AS (SELECT conv_id, CAST(0 AS BIGINT), [{{'c': 0, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 1000000000, 'a': ''}}] FROM counts
  UNION ALL SELECT d.conv_id, f.n, CASE WHEN forced THEN [{", ".join(_way(q, "'D'", "2") for q in (1, 2, 3, 4))}]
    ELSE [{_way(1, "'D'", "2")}, list_min([{_way(2, "'D'", "2")}, CASE WHEN initial = 's' THEN {_way(1, "'K'", "own")} END]),
      list_min([{_way(3, "'D'", "2")}, {_stays("u", (1, 2, 4), (3,))}]), list_min([{_way(4, "'D'", "2")}, {_stays("a", (3,), (1, 2, 4))}])] END
  FROM dp d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.n = d.n + 1),
best AS (SELECT c.*, list_min([{_way(1, "''", "0")}, {_way(2, "'II'", "10")}, {_way(3, "'I'", "5")}, {_way(4, "''", "0")}]) AS x FROM dp JOIN counts c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.n = dp.n),
letters AS (SELECT conv_id, i, x.a[i] AS l, len(replace(x.a[1:i], 'I', '')) AS n, len(replace(x.a[1:i], 'D', '')) AS k FROM (SELECT conv_id, x, unnest(range(1, len(x.a) + 1)) AS i FROM best)),
lines AS (SELECT l.*, f.role, f.text, max(CAST(k = 1 AND l = 'K' AND initial = 's' AS INTEGER)) OVER (PARTITION BY l.conv_id) AS opens FROM letters l LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.n AND l <> 'I' WHERE l <> 'D'),
fixed AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (k - opens) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i) AS t FROM lines GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN fixed f ON f.conv_id IS NOT DISTINCT FROM d.conv_id"""

SQL = {"op12_conversation_repair": OP12, "op13_ranked_search": OP13, "op2_suffix_dedup": OP2, "op6_jaccard_join": OP6, "op7_quality_rules": OP7}
