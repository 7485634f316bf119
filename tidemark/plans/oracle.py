"""Equivalent DuckDB statements, written apart from the DataFrame code; only literal lists are shared."""

from __future__ import annotations

from tidemark.functions.text import LABEL, LEGAL_SUFFIXES
from tidemark.operators.cycle import CYCLES
from tidemark.operators.lexicon import LEXICON, OUTCOMES, STOPWORDS
from tidemark.plans.queries import BLOCKLIST, CUES, HEADER, OUT, RULES, SECTORS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def _in(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


def _any(patterns) -> str:
    return _q("|".join(f"(?:{p})" for p in patterns))


_WORDS = {(d, c): sorted(set(ws.split())) for d, c, ws in LEXICON}
_ALL = sorted({w for ws in _WORDS.values() for w in ws})

ADS = """ads AS (SELECT *, year(issue_date) AS year, year(issue_date) || 'Q' || quarter(issue_date) AS yq, (year(issue_date) // 10) * 10 AS decade
  FROM (SELECT doc_id AS row_id, source AS brand, CAST(DATE '1972-01-01' + CAST(doc_id * 37 % 15300 AS INTEGER) AS DATE) AS issue_date, coalesce(text, '') AS text FROM documents))"""
CAL = f"""cal AS (SELECT year(m) || 'Q' || quarter(m) AS yq, CAST(count(*) FILTER (rec) AS BIGINT) AS recession_months, count(*) FILTER (rec) >= 2 AS recession_majority, count(*) FILTER (rec) >= 1 AS recession_any
  FROM (SELECT m, EXISTS (SELECT 1 FROM (VALUES {", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in CYCLES)}) c(p, t) WHERE m >= p + INTERVAL 1 MONTH AND m <= t) AS rec
        FROM (SELECT CAST(unnest(generate_series(DATE '1948-01-01', DATE '2014-12-01', INTERVAL 1 MONTH)) AS DATE) AS m)) GROUP BY 1)"""


def _scores(variant: str = "all", name: str = "s") -> str:
    keep = {"all": "true", "no_stopwords": f"w NOT IN {_in(STOPWORDS)}", "dictionary_only": f"w IN {_in(_ALL)}"}[variant]
    counts = ", ".join(f"CAST(len(list_filter(tok, lambda w: w IN {_in(_WORDS[d, c])})) AS BIGINT) AS {o}" for o, d, c in OUTCOMES)
    return f"""{name} AS (SELECT row_id, brand, issue_date, year, yq, decade, CAST(len(tok) AS BIGINT) AS total_words, {counts}
  FROM (SELECT * EXCLUDE (text), list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda w: {keep}) AS tok FROM ads))"""


def _series(kind: str, source: str = "s", name: str = "q", where: str = "true") -> str:
    value = {"macro": "100 * avg({o} / total_words)", "pooled": "100 * sum({o}) / sum(total_words)"}[kind]
    return f"{name} AS (SELECT yq, {', '.join(value.format(o=o) + ' AS ' + o for o in OUT)}, count(*) AS ads FROM {source} WHERE total_words > 0 AND {where} GROUP BY yq)"


def _panel(series: str = "q", name: str = "p") -> str:
    rows = " UNION ALL ".join(f"SELECT yq, '{o}' AS outcome, {o} AS y FROM {series}" for o in OUT)
    return f"""{name} AS (SELECT yq, outcome, y, CAST(recession_majority AS INTEGER) AS x, CAST(recession_any AS INTEGER) AS x_any, CAST(yq[1:4] AS INTEGER) // 10 * 10 AS decade,
  CAST(CAST(yq[1:4] AS INTEGER) >= 1973 AS INTEGER) AS post, row_number() OVER (PARTITION BY outcome ORDER BY yq) - 1 AS t FROM ({rows}) JOIN cal USING (yq))"""


BASE = f"WITH {ADS}, {CAL}, {_scores()}"
MACRO = f"{BASE}, {_series('macro')}, {_panel()}"
POOLED = f"{BASE}, {_series('pooled')}, {_panel()}"


def _r(names, prefix: str = "") -> str:
    return ", ".join(f"round({n}, 9) AS {n.split('.')[-1]}" for n in names)


def _gap(source: str, by: str, x: str) -> str:
    return f"SELECT {by}, avg(y) FILTER ({x}) - avg(y) FILTER (NOT ({x})) AS gap, avg(y) FILTER ({x}) AS mean_recession, avg(y) FILTER (NOT ({x})) AS mean_expansion, avg(y) AS mean_y FROM {source} GROUP BY {by}"


def _hac(with_: str, controls=(), within: str = "", x: str = "x", lags: int = 4, select: str = "round(coef, 9) AS coef, round(se, 9) AS se, n", factor: str = "1", source: str = "p", cell: str = "outcome") -> str:
    """The same estimator as a chain of common table expressions, one for each control."""
    group = f"PARTITION BY {cell}" + (f", {within}" if within else "")
    cols = {f"c{i}": c for i, c in enumerate(controls)} | {"xt": x, "yt": "y"}
    chain = [f"d0 AS (SELECT *, {', '.join(f'{v} - avg({v}) OVER ({group}) AS {k}' for k, v in cols.items())} FROM {source})"]
    names = list(cols)
    for i in range(len(controls)):
        rest = ", ".join(f"{n} - coalesce(sum({n} * c{i}) OVER w / nullif(sum(c{i} * c{i}) OVER w, 0), 0) * c{i} AS {n}" for n in names[i + 1 :])
        chain.append(f"d{i + 1} AS (SELECT * REPLACE ({rest}) FROM d{i} WINDOW w AS (PARTITION BY {cell}))")
    last = f"d{len(controls)}"
    chain += [
        f"e AS (SELECT *, yt - b * xt AS res FROM (SELECT *, sum(xt * xt) OVER w AS sxx, sum(xt * yt) OVER w / sum(xt * xt) OVER w AS b FROM {last} WINDOW w AS (PARTITION BY {cell})))",
        f"u AS (SELECT *, xt * res AS u0, res - lag(res) OVER w AS dr, {', '.join(f'xt * res * lag(xt * res, {k}) OVER w AS u{k}' for k in range(1, lags + 1))} FROM e WINDOW w AS (PARTITION BY {cell} ORDER BY yq))",
    ]
    v = "sum(u0 * u0)" + "".join(f" + 2 * (1 - {k} / {lags + 1}) * coalesce(sum(u{k}), 0)" for k in range(1, lags + 1))
    return f"{with_}, {', '.join(chain)}, h AS (SELECT {cell}, max(b) AS coef, sqrt(({v}) * {factor} / max(sxx) ** 2) AS se, sum(dr * dr) / sum(res * res) AS dw, count(*) AS n, avg(y) AS mean_y FROM u GROUP BY {cell}) SELECT {cell}, {select} FROM h"


#: Points of Simpson's rule in the integrals of tails.
_POINTS = 2000
_SIMPSON_WEIGHT = f"(CASE WHEN i = 0 OR i = {_POINTS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"


def _beta(a: str, b: str, x: str) -> str:
    """Incomplete beta function as an integral over an angle, of powers of its sine and cosine."""
    end = f"asin(sqrt({x}))"
    return f"(2 * exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) * {end} / {3 * _POINTS} * list_sum(list_transform(range({_POINTS + 1}), lambda i: {_SIMPSON_WEIGHT} * pow(sin({end} * i / {_POINTS}), 2 * {a} - 1) * pow(cos({end} * i / {_POINTS}), 2 * {b} - 1))))"


def _t_p(t: str, df: str) -> str:
    return _beta(f"(({df}) / 2.0)", "0.5", f"(({df}) / (({df}) + ({t}) * ({t})))")


def _f_p(f: str, d1: str, d2: str) -> str:
    return _beta(f"(({d2}) / 2.0)", f"(({d1}) / 2.0)", f"(({d2}) / (({d2}) + ({d1}) * ({f})))")


def _chi2_p(x: str, k: int) -> str:
    """One less an integral over the root."""
    end = f"sqrt({x})"
    return f"(1 - {2 ** (1 - k / 2)!r} / gamma({k / 2}) * {end} / {3 * _POINTS} * list_sum(list_transform(range({_POINTS + 1}), lambda i: {_SIMPSON_WEIGHT} * pow({end} * i / {_POINTS}, {k - 1}) * exp(-pow({end} * i / {_POINTS}, 2) / 2))))"


def _t_end(df: str) -> str:
    """The t of a 95 % interval, by Newton's rule."""
    density = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0) - 0.5 * ln(({df}) * pi()) - (({df}) + 1) / 2.0 * ln(1 + t * t / ({df})))"
    return f"list_reduce(list_prepend(1.95, list_transform(range(12), lambda j: CAST(j AS DOUBLE))), lambda t, j: t + ({_t_p('t', df)} - 0.05) / (2 * {density}))"


def _linear(with_: str, source: str, xs: tuple[str, ...], lags: int = 4) -> str:
    """Every slope of a model apart: the other regressors are taken out of each other, of this one and of y, one by one."""
    k, out = len(xs), []
    for target in xs:
        names = [*[x for x in xs if x != target], target, "y"]
        cols = [f"q{i}" for i in range(k)] + ["yt"]
        chain = [f"d0 AS (SELECT outcome, yq, y, count(*) OVER w AS n, {', '.join(f'{v} - avg({v}) OVER w AS {c}' for v, c in zip(names, cols))} FROM {source} WHERE {' AND '.join(f'{x} IS NOT NULL' for x in xs)} WINDOW w AS (PARTITION BY outcome))"]
        for i in range(k):
            rest = ", ".join(f"{c} - sum({c} * q{i}) OVER w / sum(q{i} * q{i}) OVER w * q{i} AS {c}" for c in cols[i + 1 :])
            b = f", sum(yt * q{i}) OVER w / sum(q{i} * q{i}) OVER w AS b" if i == k - 1 else ""
            chain.append(f"d{i + 1} AS (SELECT * REPLACE ({rest}){b} FROM d{i} WINDOW w AS (PARTITION BY outcome))")
        leverage = "1.0 / n" + "".join(f" + q{i} * q{i} / sum(q{i} * q{i}) OVER w" for i in range(k))
        x = f"q{k - 1}"
        chain.append(f"e AS (SELECT *, yt AS res, {leverage} AS h FROM d{k} WINDOW w AS (PARTITION BY outcome))")
        chain.append(f"u AS (SELECT *, res * res - avg(res * res) OVER v AS s, {x} * res AS u0, {', '.join(f'{x} * res * lag({x} * res, {j}) OVER w AS u{j}' for j in range(1, lags + 1))} FROM e WINDOW w AS (PARTITION BY outcome ORDER BY yq), v AS (PARTITION BY outcome))")
        long_run = "sum(u0 * u0)" + "".join(f" + 2 * (1 - {j} / {lags + 1}) * coalesce(sum(u{j}), 0)" for j in range(1, lags + 1))
        fit = " + ".join(f"sum(q{i} * s) ** 2 / sum(q{i} * q{i})" for i in range(k))
        chain.append(f"m AS (SELECT outcome, max(n) AS n, max(b) AS coef, sqrt({long_run}) / sum({x} * {x}) AS se_hac, sqrt(sum(({x} * res / (1 - h)) ** 2)) / sum({x} * {x}) AS se_hc3, sqrt(sum(res * res) / (max(n) - {k + 1}) / sum({x} * {x})) AS se_ols, 1 - sum(res * res) / (var_pop(y) * max(n)) AS r2, max(n) * ({fit}) / sum(s * s) AS bp_lm FROM u GROUP BY outcome)")
        out.append(f"SELECT *, r2 / {k} / ((1 - r2) / (n - {k + 1})) AS f, bp_lm / n / {k} / ((1 - bp_lm / n) / (n - {k + 1})) AS bp_f, '{target}' AS term FROM ({with_}, {', '.join(chain)} SELECT * FROM m)")
    return " UNION ALL ".join(out)


def _macro_controls() -> str:
    """Written out apart from the query's list of models."""
    series = f"""{MACRO}, sl AS (SELECT year(l_shipdate) + 8 AS year, quarter(l_shipdate) AS q, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS value, CAST(sum(l_quantity) AS BIGINT) AS pieces FROM lineitem GROUP BY 1, 2),
      gr AS (SELECT year || 'Q' || q AS yq, 100 * (value / nullif(lag(value) OVER (ORDER BY year, q), 0) - 1) AS growth FROM sl), yr AS (SELECT year, CAST(sum(value) AS BIGINT) / CAST(sum(pieces) AS BIGINT) AS price FROM sl GROUP BY 1),
      fl AS (SELECT a.year, 100 * (a.price / b.price - 1) AS inflation FROM yr a JOIN yr b ON a.year = b.year + 1),
      full_ AS (SELECT p.*, growth, inflation FROM p LEFT JOIN gr USING (yq) LEFT JOIN fl ON CAST(yq[1:4] AS INTEGER) = fl.year), restricted_ AS (SELECT * FROM full_ WHERE inflation IS NOT NULL)"""
    models = [("full", ("x",)), ("restricted", ("x",)), ("restricted", ("x", "inflation", "t")), ("restricted", ("growth",)), ("restricted", ("growth", "inflation", "t")), ("full", ("x", "growth")), ("full", ("growth",))]
    label = {"x": "recession", "t": "trend"}
    parts = [f"SELECT *, '{'+'.join(label.get(x, x) for x in xs)}' AS model, '{sample}' AS sample, {_f_p('f', str(len(xs)), f'n - {len(xs) + 1}')} AS f_p, {_chi2_p('bp_lm', len(xs))} AS bp_lm_p FROM ({_linear(series, sample + '_', xs)})" for sample, xs in models]
    normal = "(1 - sqrt(2 / pi()) * abs(coef / se_hac) / 6000 * list_sum(list_transform(range(2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(coef / se_hac * i / 2000, 2) / 2))))"
    return f"SELECT outcome, model, sample, term, round(coef, 9) AS coef, round(se_hac, 9) AS se_hac, round(greatest(0, {normal}), 9) AS p_hac, round(se_hc3, 9) AS se_hc3, round(r2, 9) AS r2, round(f, 9) AS f, round(f_p, 9) AS f_p, round(bp_lm, 9) AS bp_lm, round(bp_lm_p, 9) AS bp_lm_p, n FROM ({' UNION ALL '.join(parts)})"


_VARIANTS = ("all", "no_stopwords", "dictionary_only")
# Word boundaries of Latin text, written out apart from the query's classes.
_FOLLOW = r"[\p{M}\p{Cf}]*"
_LETTER, _DIGIT = rf"[\p{{L}}\p{{Nl}}]{_FOLLOW}", rf"\p{{Nd}}{_FOLLOW}"
_BOTH = r".''\x{2018}\x{2019}\x{2024}\x{FE52}\x{FF07}\x{FF0E}"
_WORD_RULE = rf"(?:{_LETTER}(?:[:\x{{B7}}\x{{387}}\x{{55F}}\x{{5F4}}\x{{2027}}\x{{FE13}}\x{{FE55}}\x{{FF1A}}{_BOTH}]{_FOLLOW}{_LETTER})*|{_DIGIT}(?:[,;\x{{37E}}\x{{589}}\x{{60C}}\x{{60D}}\x{{66C}}\x{{7F8}}\x{{2044}}\x{{FE10}}\x{{FE14}}\x{{FE50}}\x{{FE54}}\x{{FF0C}}\x{{FF1B}}{_BOTH}]{_FOLLOW}{_DIGIT})*|[\p{{Pc}}\x{{202F}}]{_FOLLOW})+"
_N = r"regexp_replace(regexp_replace(lower(text), '-\s+', '', 'g'), '\s+', ' ', 'g')"
_TOKENS = r"len(regexp_extract_all(text, '\S+'))"
_HEAD = f"len(regexp_extract_all(text, {_q(HEADER)}))"
_HITS = ", ".join(f"regexp_matches({_N}, {_any(p)}) AS rule_{k}" for k, p in RULES.items())
_V1 = f"(coalesce(brand IN {_in(BLOCKLIST)}, false) OR {_TOKENS} < 10 OR {_HEAD} >= 2)"
_V2 = f"({_V1} OR coalesce(lower(trim(brand)) IN {_in([b.lower() for b in BLOCKLIST])}, false))"
_V3 = f"({_V2} OR regexp_matches({_N}, {_any([p for ps in RULES.values() for p in ps])}))"
VERSIONS = f"v AS (SELECT row_id, decade, brand, {_V1} AS v1, {_V2} AS v2, {_V3} AS v3 FROM ads)"
LABELLED = f"l AS (SELECT v.*, quality = 0 AS non_ad FROM v JOIN labels ON row_id = doc_id)"
STRATA = f"""st AS (SELECT row_id, decade, words, CASE WHEN cue THEN 'cue' WHEN words >= cut THEN 'long' ELSE 'other' END AS stratum
  FROM (SELECT row_id, decade, {_TOKENS} AS words, regexp_matches(text, {_q("(?i)" + "|".join(f"(?:{c})" for c in CUES))}) AS cue FROM ads)
  JOIN (SELECT decade, quantile_cont({_TOKENS}, 0.85) AS cut FROM ads GROUP BY decade) USING (decade))"""
# The allocation, written out apart from the query's.
_QUOTA = "(CASE WHEN decade = 1940 THEN CASE stratum WHEN 'cue' THEN 3 WHEN 'long' THEN 2 WHEN 'other' THEN 5 END ELSE CASE stratum WHEN 'cue' THEN 5 WHEN 'long' THEN 5 WHEN 'other' THEN 10 END END)"


def _drawn(pool: str) -> str:
    return f"""dr AS (SELECT row_id, decade, stratum, population, population / least({_QUOTA}, population) AS weight FROM
  (SELECT *, count(*) OVER (PARTITION BY decade, stratum) AS population, row_number() OVER (PARTITION BY decade, stratum ORDER BY md5('314:' || row_id), row_id) AS rank FROM {pool}) WHERE rank <= {_QUOTA})"""


_PLAIN = "regexp_replace(replace(lower(brand), '&', ' and '), '[^a-z0-9 ]+', ' ', 'g')"
_KEPT = f"list_filter(string_split({_PLAIN}, ' '), lambda w: w <> '' AND NOT list_contains({_list(LEGAL_SUFFIXES)}, w))"
_KEY = f"CASE WHEN len({_KEPT}) > 0 THEN array_to_string({_KEPT}, ' ') ELSE trim(lower(brand)) END"
_RULE = lambda ws: _q("|".join(rf"\b{w[:-1]}" if w.endswith("*") else rf"\b{w}\b" for w in ws))
_SECTOR = "CASE " + " ".join(f"WHEN regexp_matches(brand_key, {_RULE(ws)}) THEN '{s}'" for s, ws in SECTORS) + " ELSE 'Other' END"
SECTORED = f"sec AS (SELECT *, {_SECTOR} AS sector FROM (SELECT * EXCLUDE (text), coalesce({_KEY}, '(missing brand)') AS brand_key FROM ads))"
STATED = "stt AS (SELECT sec.*, recession_majority AS state FROM sec JOIN cal USING (yq))"
RATIO = "ry AS (SELECT row_id, 100 * harvard_pos / total_words AS y FROM s WHERE total_words > 0)"
REVENUE = "rev AS (SELECT year(l_shipdate) || 'Q' || quarter(l_shipdate) AS yq, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS value FROM lineitem GROUP BY 1)"
GROWTH = """gr AS (SELECT yq, CAST(value AS BIGINT) AS value, growth, coalesce(growth < 0, false) AND coalesce(lag(coalesce(growth < 0, false)) OVER (ORDER BY yq), false) AS technical
  FROM (SELECT yq, value, 100 * (value / lag(value) OVER (ORDER BY yq) - 1) AS growth FROM rev))"""
CWORDS = "unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word"
STATED_ADS = "sa AS (SELECT ads.*, recession_majority AS recession FROM ads JOIN cal USING (yq))"


def _odds(counts: str, group: str, prior: str = "1e3", name: str = "lo") -> str:
    """z of each word from counts(grp..., decade, recession, word, n)."""
    g = f"{group}, " if group else ""
    on = f"USING ({g}decade)"
    return f"""voc AS (SELECT word, {prior} * sum(n) / (SELECT sum(n) FROM base) AS alpha FROM base GROUP BY word HAVING sum(n) >= 50),
 sides AS (SELECT {g}decade, coalesce(sum(n) FILTER (recession), 0) AS n_r, coalesce(sum(n) FILTER (NOT recession), 0) AS n_e FROM {counts} GROUP BY ALL),
 seen AS (SELECT {g}decade, word, coalesce(sum(n) FILTER (recession), 0) AS y_r, coalesce(sum(n) FILTER (NOT recession), 0) AS y_e FROM {counts} GROUP BY ALL),
 parts AS (SELECT {g}word, ln((coalesce(y_r, 0) + alpha) / (n_r + {prior} - coalesce(y_r, 0) - alpha)) - ln((coalesce(y_e, 0) + alpha) / (n_e + {prior} - coalesce(y_e, 0) - alpha)) AS d,
   1 / (coalesce(y_r, 0) + alpha) + 1 / (coalesce(y_e, 0) + alpha) AS v
   FROM (SELECT * FROM sides, voc WHERE n_r > 0 AND n_e > 0) LEFT JOIN seen USING ({g}decade, word)),
 {name} AS (SELECT {g}word, sum(d / v) / sum(1 / v) AS delta, sum(d / v) / sum(1 / v) * sqrt(sum(1 / v)) AS z FROM parts GROUP BY {g}word)"""


def _gap_parts(kind: str, x: str, definition: str) -> str:
    return f"SELECT '{kind}' AS aggregation, '{definition}' AS definition, outcome, round(gap, 9) AS gap FROM ({_gap('p_' + kind, 'outcome', x + ' = 1')})"


_BOTH = f"{BASE}, {_series('macro', name='q_macro')}, {_series('pooled', name='q_pooled')}, {_panel('q_macro', 'p_macro')}, {_panel('q_pooled', 'p_pooled')}"
_THREE = f"WITH {ADS}, {CAL}, " + ", ".join(_scores(v, f"s_{v}") for v in ("all", "no_stopwords", "dictionary_only"))
_RATES = """tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, tn / nullif(tn + fp, 0) AS specificity, (tp + tn) / (tp + fp + fn + tn) AS agreement, fn / nullif(fn + tn, 0) AS residual"""
_CELLS = lambda v: f"SELECT '{v}' AS version, count(*) FILTER ({v} AND non_ad) AS tp, count(*) FILTER ({v} AND NOT non_ad) AS fp, count(*) FILTER (NOT {v} AND non_ad) AS fn, count(*) FILTER (NOT {v} AND NOT non_ad) AS tn FROM l"
#: Two-sided p-values by Simpson's rule over 400 steps: the normal one, and Student's by the angle atan(t / sqrt(df)).
_SIMPSON = lambda f: f"list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f}))"
_NORMAL_P = f"CASE WHEN se > 1e-12 THEN greatest(0, 1 - sqrt(2 / pi()) * {_SIMPSON('exp(-((least(abs(coef / nullif(se, 0)), 9) * i / 400) ** 2) / 2)')} * least(abs(coef / nullif(se, 0)), 9) / 1200) END"
_T_P = lambda t, df: f"1 - {_SIMPSON(f'cos(atan(abs({t}) / sqrt({df})) * i / 400) ** ({df} - 1)')} * atan(abs({t}) / sqrt({df})) / ({_SIMPSON(f'cos(pi() / 2 * i / 400) ** ({df} - 1)')} * pi() / 2)"
_KEPT_ROWS = f"""kv AS (SELECT row_id, unnest(['none', CASE WHEN NOT v1 THEN 'v1' END, CASE WHEN NOT v2 THEN 'v2' END, CASE WHEN NOT v3 THEN 'v3' END]) AS version FROM v),
  sv AS (SELECT s.*, version FROM s JOIN kv USING (row_id) WHERE total_words > 0 AND version IS NOT NULL)"""
_GRID_SOURCE = f"""{BASE}, {VERSIONS}, {_KEPT_ROWS}, p AS (SELECT version, aggregation, definition, outcome, yq, y, CAST(yq[1:4] AS INTEGER) // 10 * 10 AS decade, 4 * CAST(yq[1:4] AS INTEGER) + CAST(yq[6:6] AS INTEGER) AS t,
    CAST(CASE definition WHEN 'any' THEN recession_any ELSE recession_majority END AS INTEGER) AS x
  FROM ({" UNION ALL ".join(f"SELECT version, yq, '{k}' AS aggregation, '{o}' AS outcome, {v.format(o=o)} AS y FROM sv GROUP BY version, yq" for o in OUT for k, v in (("macro", "100 * avg({o} / total_words)"), ("pooled", "100 * sum({o}) / sum(total_words)")))})
  JOIN cal USING (yq), (VALUES ('majority'), ('any')) d(definition))"""
_QUARTERLY = " UNION ALL ".join(
    f"SELECT version, 'quarterly' AS level, aggregation, definition, outcome, '{s}' AS spec, coef, se, {_NORMAL_P} AS p, mean_y, n FROM ({_hac(_GRID_SOURCE, c, w, cell='version, aggregation, definition, outcome', select='coef, se, mean_y, n')})"
    for s, c, w in (("raw", (), ""), ("trend", ("t",), ""), ("decade", (), "decade"))
)


def _records(spec: str, effect: str, dummies: tuple[int, ...]) -> str:
    """Fixed effects row by row: one mean for each effect, decades taken out one after another."""
    names = [*[f"c{i}" for i in range(len(dummies))], "xt", "yt"]
    cols = dict(zip(names, [*[f"CAST(decade = {d} AS INTEGER)" for d in dummies], "x", "y"], strict=True))
    chain = [f"d0 AS (SELECT *, {', '.join(f'{v} - avg({v}) OVER (PARTITION BY version, outcome, {effect}) AS {k}' for k, v in cols.items())} FROM r)"]
    for i in range(len(dummies)):
        rest = ", ".join(f"{n} - coalesce(sum({n} * c{i}) OVER w / nullif(sum(c{i} * c{i}) OVER w, 0), 0) * c{i} AS {n}" for n in names[i + 1 :])
        chain.append(f"d{i + 1} AS (SELECT * REPLACE ({rest}) FROM d{i} WINDOW w AS (PARTITION BY version, outcome))")
    return f"""SELECT version, 'ad' AS level, 'per ad' AS aggregation, 'majority' AS definition, outcome, '{spec}' AS spec, coef, se, {_T_P('coef / se', '(g - 1)')} AS p, mean_y, n FROM (
      {BASE}, {VERSIONS}, {_KEPT_ROWS}, {SECTORED}, {STATED}, a AS (SELECT sv.*, stt.* EXCLUDE (row_id, brand, issue_date, year, yq, decade), count(*) OVER (PARTITION BY version, brand_key) AS ads FROM sv JOIN stt USING (row_id)),
      r AS ({" UNION ALL ".join(f"SELECT version, '{o}' AS outcome, brand_key, decade, year, CAST(state AS INTEGER) AS x, 100 * {o} / total_words AS y FROM a WHERE ads >= 2" for o in OUT)}), {", ".join(chain)},
      b AS (SELECT version, outcome, sum(xt * yt) / sum(xt * xt) AS b, sum(xt * xt) AS sxx, count(*) AS n, avg(y) AS mean_y FROM d{len(dummies)} GROUP BY ALL),
      gs AS (SELECT version, outcome, year, sum(xt * (yt - b * xt)) AS sc FROM d{len(dummies)} JOIN b USING (version, outcome) GROUP BY ALL), k AS (SELECT version, outcome, count(*) AS g, sum(sc * sc) AS s2 FROM gs GROUP BY ALL)
      SELECT version, outcome, b AS coef, sqrt(s2 * g / (g - 1)) / sxx AS se, mean_y, n, g FROM b JOIN k USING (version, outcome))"""


def _two_way(effect: str = "brand_key") -> str:
    dummies = (1980, 1990, 2000, 2010)
    names = [*[f"c{i}" for i in range(len(dummies))], "xt", "yt"]
    cols = dict(zip(names, [*[f"CAST(decade = {d} AS INTEGER)" for d in dummies], "x", "y"], strict=True))
    chain = [f"d0 AS (SELECT {effect}, year, {', '.join(f'{v} - avg({v}) OVER (PARTITION BY {effect}) AS {k}' for k, v in cols.items())} FROM r)"]
    for i in range(len(dummies)):
        rest = ", ".join(f"{n} - coalesce(sum({n} * c{i}) OVER () / nullif(sum(c{i} * c{i}) OVER (), 0), 0) * c{i} AS {n}" for n in names[i + 1 :])
        chain.append(f"d{i + 1} AS (SELECT * REPLACE ({rest}) FROM d{i})")
    last = f"d{len(dummies)}"
    return f"""{BASE}, {SECTORED}, {STATED}, {RATIO}, r AS (SELECT {effect}, year, decade, CAST(state AS INTEGER) AS x, y FROM stt JOIN ry USING (row_id)), {", ".join(chain)},
      b AS (SELECT sum(xt * yt) / sum(xt * xt) AS b, sum(xt * xt) AS sxx, count(*) AS n FROM {last}), g AS (SELECT year, sum(xt * (yt - b * xt)) AS s FROM {last}, b GROUP BY year), k AS (SELECT count(*) AS g, sum(s * s) AS s2 FROM g)
      SELECT round(b, 9) AS coef, round(sqrt(s2 * g / (g - 1)) / sxx, 9) AS se, n, g AS clusters FROM b, k"""


_GRID = f"""SELECT *, 100 * coef / mean_y AS pct_of_mean, 100 * coef / mean_y - 196 * se / mean_y AS ci_low_pct, 100 * coef / mean_y + 196 * se / mean_y AS ci_high_pct
  FROM ({_QUARTERLY} UNION ALL {_records("decade", "decade", ())} UNION ALL {_records("decade+advertiser", "brand_key", (1980, 1990, 2000, 2010))})"""
_GRID_KEY = "version, level, aggregation, definition, outcome, spec"
_OLS = "d AS (SELECT *, y - avg(y) OVER w AS yt, x - avg(x) OVER w AS xt, count(*) OVER w AS cnt FROM p WINDOW w AS (PARTITION BY outcome)), f AS (SELECT *, sum(xt * xt) OVER w AS sxx, sum(xt * yt) OVER w / sum(xt * xt) OVER w AS b FROM d WINDOW w AS (PARTITION BY outcome)), r AS (SELECT *, yt - b * xt AS e FROM f)"

SQL: dict[str, str] = {
    "score_counts": f"""WITH {ADS}, t AS (SELECT row_id, regexp_extract_all(lower(text), '[a-z'']+') AS tok FROM ads)
      {" UNION ALL ".join(f"SELECT row_id, '{d}' AS dictionary, '{c}' AS category, CAST(len(list_filter(tok, lambda w: w IN {_in(ws)})) AS BIGINT) AS n FROM t" for (d, c), ws in _WORDS.items())}""",
    "score_ratios_wide": f"{BASE} SELECT row_id, total_words, {', '.join(f'round(CASE WHEN total_words > 0 THEN {o} / total_words ELSE 0 END, 9) AS {o}' for o in OUT)} FROM s",
    "variant_no_stopwords": f"WITH {ADS}, {_scores('no_stopwords')} SELECT row_id, total_words, {', '.join(OUT)} FROM s",
    "variant_dictionary_only": f"WITH {ADS}, {_scores('dictionary_only')} SELECT row_id, total_words, {', '.join(OUT)} FROM s",
    "denominator_comparison": _THREE
    + " "
    + " UNION ALL ".join(f"SELECT '{v}' AS variant, round(avg(total_words), 9) AS mean_words, median(total_words) AS median_words, count(*) FILTER (total_words = 0) AS no_words, round(avg(CASE WHEN total_words > 0 THEN harvard_pos / total_words ELSE 0 END), 9) AS mean_ratio FROM s_{v}" for v in ("all", "no_stopwords", "dictionary_only")),
    "quarterly_macro": f"{BASE}, {_series('macro')} SELECT yq, {_r(OUT)}, ads FROM q",
    "quarterly_pooled": f"{BASE}, {_series('pooled')} SELECT yq, {_r(OUT)}, ads FROM q",
    "cycle_calendar": f"WITH {CAL}, {ADS} SELECT cal.*, count(row_id) AS records FROM cal LEFT JOIN ads USING (yq) GROUP BY ALL",
    "technical_recession": f"WITH {REVENUE}, {GROWTH} SELECT yq, value, round(growth, 9) AS growth, technical FROM gr",
    "rule_agreement": f"WITH {CAL}, {REVENUE}, {GROWTH} SELECT count(*) FILTER (recession_majority = technical) AS agree, count(*) FILTER (recession_majority AND NOT technical) AS missed, count(*) FILTER (NOT recession_majority AND technical) AS added FROM gr JOIN cal USING (yq) WHERE growth IS NOT NULL",
    "recession_gap_grid": _BOTH + " " + " UNION ALL ".join(_gap_parts(k, x, d) for k in ("macro", "pooled") for x, d in (("x", "majority"), ("x_any", "any"))),
    "normalized_effect": f"{MACRO}, g AS ({_gap('p', 'outcome', 'x = 1')}) SELECT outcome, {_r(['mean_recession', 'mean_expansion', 'mean_y', 'gap'])}, round(100 * gap / ((mean_recession + mean_expansion) / 2), 9) AS pct_of_level, round(100 * gap / mean_y, 9) AS pct_of_mean FROM g",
    "aggregation_comparison": f"{_BOTH}, a AS ({_gap('p_macro', 'outcome', 'x = 1')}), b AS ({_gap('p_pooled', 'outcome', 'x = 1')}), c AS (SELECT p_macro.outcome, corr(p_macro.y, p_pooled.y) AS r FROM p_macro JOIN p_pooled USING (outcome, yq) GROUP BY 1) SELECT outcome, round(a.gap, 9) AS gap_macro, round(b.gap, 9) AS gap_pooled, round(r, 9) AS correlation, a.gap * b.gap >= 0 AS same_sign FROM a JOIN b USING (outcome) JOIN c USING (outcome)",
    "sensitivity_range": f"{_THREE}, {', '.join(_series('macro', f's_{v}', f'q_{v}') + ', ' + _panel(f'q_{v}', f'p_{v}') for v in ('all', 'no_stopwords', 'dictionary_only'))}, g AS ({' UNION ALL '.join(_gap(f'p_{v}', 'outcome', 'x = 1') for v in ('all', 'no_stopwords', 'dictionary_only'))}) SELECT outcome, round(max(100 * gap / ((mean_recession + mean_expansion) / 2)) - min(100 * gap / ((mean_recession + mean_expansion) / 2)), 9) AS range_pct, bool_and(gap > 0) AS all_up, bool_and(gap < 0) AS all_down FROM g GROUP BY outcome",
    "quality_flags_v1": f"""WITH {ADS} SELECT *, is_non_advertiser OR is_multipage OR too_short AS any_flag FROM (SELECT row_id, brand, decade, {_TOKENS} AS token_count, {_HEAD} AS header_count, len(regexp_extract_all(text, {_q(LABEL)})) AS label_count,
      coalesce(brand IN {_in(BLOCKLIST)}, false) AS is_non_advertiser, {_HEAD} >= 2 AS is_multipage, {_TOKENS} < 10 AS too_short FROM ads)""",
    "filter_v2": f"WITH {ADS}, {VERSIONS} SELECT row_id, v1, v2 FROM v",
    "filter_v3_rules": f"WITH {ADS} SELECT row_id, {_HITS} FROM ads",
    "rule_hits_by_decade": f"WITH {ADS}, h AS (SELECT decade, {_HITS} FROM ads) SELECT decade, count(*) AS n, {', '.join(f'count(*) FILTER (rule_{r}) AS n_{r}' for r in RULES)} FROM h GROUP BY decade",
    "flag_rate_by_decade": f"WITH {ADS}, {VERSIONS} SELECT decade, {', '.join(f'round(100 * avg(CAST({c} AS INTEGER)), 9) AS pct_{c}' for c in ('v1', 'v2', 'v3'))} FROM v GROUP BY decade",
    "blocklist_candidates": f"WITH {ADS} SELECT brand, count(*) FILTER ({_TOKENS} > 1000) AS long_records, count(*) AS records FROM ads GROUP BY brand HAVING count(*) FILTER ({_TOKENS} > 1000) > 0 ORDER BY long_records DESC, brand LIMIT 40",
    "filter_before_after": f"{BASE}, {VERSIONS}, sv AS (SELECT s.*, v3 FROM s JOIN v USING (row_id)), {_series('macro', 'sv', 'q1')}, {_series('macro', 'sv', 'q2', 'NOT v3')}, {_panel('q1', 'p1')}, {_panel('q2', 'p2')}, a AS ({_gap('p1', 'outcome', 'x = 1')}), b AS ({_gap('p2', 'outcome', 'x = 1')}) SELECT outcome, round(a.gap, 9) AS gap_before, round(b.gap, 9) AS gap_after, round(b.gap - a.gap, 9) AS change, a.gap * b.gap >= 0 AS same_direction FROM a JOIN b USING (outcome)",
    "confusion_metrics": f"WITH {ADS}, {VERSIONS}, {LABELLED}, c AS ({' UNION ALL '.join(_CELLS(v) for v in ('v1', 'v2', 'v3'))}), m AS (SELECT *, {_RATES} FROM c) SELECT version, tp, fp, fn, tn, {_r(['precision', 'recall', 'specificity', 'agreement', 'residual'])} FROM m",
    "wilson_kappa": f"""WITH {ADS}, {VERSIONS}, {LABELLED}, c AS ({_CELLS('v3')}), k AS (SELECT *, tp / nullif(tp + fn, 0) AS p, tp + fn AS n, tp + fp + fn + tn AS a FROM c)
      SELECT round(greatest(0, (p + 3.8416e0 / (2 * n)) / (1 + 3.8416e0 / n) - 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4 * n * n)) / (1 + 3.8416e0 / n)), 9) AS low,
      round(least(1, (p + 3.8416e0 / (2 * n)) / (1 + 3.8416e0 / n) + 1.96e0 * sqrt(p * (1 - p) / n + 3.8416e0 / (4 * n * n)) / (1 + 3.8416e0 / n)), 9) AS high,
      round(((tp + tn) / a - ((tp + fp) / a * (tp + fn) / a + (fn + tn) / a * (fp + tn) / a)) / nullif(1 - ((tp + fp) / a * (tp + fn) / a + (fn + tn) / a * (fp + tn) / a), 0), 9) AS kappa FROM k""",
    "missed_by_reason": f"WITH {ADS}, {VERSIONS}, {LABELLED} SELECT decade, count(*) AS missed, string_agg(DISTINCT brand, ',' ORDER BY brand) AS brands FROM l WHERE non_ad AND NOT v3 GROUP BY decade",
    "stratified_sample": f"WITH {ADS}, {STRATA}, pool AS (SELECT * FROM st WHERE row_id NOT IN (SELECT doc_id FROM labels)), {_drawn('pool')} SELECT row_id, decade, stratum, population, round(weight, 9) AS weight FROM dr",
    "simple_sample": f"WITH {ADS} SELECT row_id, brand FROM ads ORDER BY md5('314:' || row_id), row_id LIMIT 100",
    "weighted_recall": f"WITH {ADS}, {STRATA}, {_drawn('st')}, {VERSIONS}, {LABELLED}, j AS (SELECT l.*, weight FROM l JOIN dr USING (row_id)) SELECT round(coalesce(sum(weight) FILTER (v3 AND non_ad), 0) / nullif(sum(weight) FILTER (non_ad), 0), 9) AS recall, round(coalesce(sum(weight) FILTER (v3 AND non_ad), 0) / nullif(sum(weight) FILTER (v3), 0), 9) AS precision, round(coalesce(sum(weight) FILTER (non_ad), 0) / sum(weight), 9) AS prevalence FROM j",
    "audit_sample": f"WITH {ADS}, h AS (SELECT row_id, {_HITS} FROM ads WHERE row_id NOT IN (SELECT doc_id FROM labels)), u AS ({' UNION ALL '.join(f'SELECT {_q(r)} AS rule, row_id FROM h WHERE rule_{r}' for r in RULES)}) SELECT rule, row_id FROM u QUALIFY row_number() OVER (PARTITION BY rule ORDER BY md5('314:' || rule || ':' || row_id), row_id) <= 30",
    "word_count_profile": f"WITH {ADS}, c AS (SELECT {_TOKENS} AS n FROM ads) SELECT count(*) AS count, round(avg(n), 9) AS mean, round(stddev_samp(n), 9) AS std, min(n) AS min, max(n) AS max, {', '.join(f'count(*) FILTER (n < {k}) AS under_{k}' for k in (1, 5, 10, 15, 20, 30))} FROM c",
    "word_count_quantiles": f"WITH {ADS} SELECT decade, {', '.join(f'round(quantile_cont({_TOKENS}, {q / 100}), 9) AS q{q}' for q in (25, 50, 75, 85))} FROM ads GROUP BY decade",
    "brand_key": f"WITH b AS (SELECT s_name AS brand FROM supplier UNION SELECT p_brand || ' & Co. ' || p_type FROM part) SELECT brand, {_KEY} AS brand_key FROM b",
    "sector_assign": f"WITH {ADS}, {SECTORED} SELECT DISTINCT brand, brand_key, sector FROM sec",
    "sector_share_crosstab": f"WITH {ADS}, {SECTORED} SELECT yq, {', '.join(f'round(count(*) FILTER (sector = {_q(s)}) / count(*), 9) AS {s.lower()}' for s in [*[s for s, _ in SECTORS], 'Other'])} FROM sec GROUP BY yq",
    "composition_series": f"WITH {ADS}, {SECTORED}, lr AS (SELECT brand_key, count(DISTINCT year) >= 10 AS lr FROM sec GROUP BY 1) SELECT yq, count(*) AS ads, count(DISTINCT brand_key) AS advertisers, round(avg(CAST(lr AS INTEGER)), 9) AS long_running_share, round(count(*) / count(DISTINCT brand_key), 9) AS ads_per_advertiser FROM sec JOIN lr USING (brand_key) GROUP BY yq",
    "long_running_share": f"WITH {ADS}, {SECTORED} SELECT brand_key, count(*) AS ads, count(DISTINCT year) AS years, count(DISTINCT year) >= 10 AS long_running FROM sec GROUP BY 1",
    "switchers": f"WITH {ADS}, {CAL}, {SECTORED}, {STATED} SELECT brand_key, count(*) AS ads FROM stt GROUP BY 1 HAVING count(*) >= 2 AND bool_or(state) AND NOT bool_and(state)",
    "shift_share": f"""{BASE}, {SECTORED}, {STATED}, {RATIO}, d AS (SELECT decade, sector, state, y FROM stt JOIN ry USING (row_id)),
      tot AS (SELECT decade, count(*) FILTER (state) AS tr, count(*) FILTER (NOT state) AS te FROM d GROUP BY 1 HAVING tr > 0 AND te > 0),
      c AS (SELECT decade, sector, count(*) FILTER (state) AS nr, count(*) FILTER (NOT state) AS ne, avg(y) FILTER (state) AS mr, avg(y) FILTER (NOT state) AS me FROM d GROUP BY 1, 2),
      f AS (SELECT decade, tr, nr / tr AS wr, ne / te AS we, coalesce(mr, me) AS mr, coalesce(me, mr) AS me FROM c JOIN tot USING (decade))
      SELECT decade, max(tr) AS recession_ads, round(sum((wr - we) * (mr + me) / 2), 9) AS "between", round(sum((wr + we) / 2 * (mr - me)), 9) AS within, round(sum((wr - we) * (mr + me) / 2) + sum((wr + we) / 2 * (mr - me)), 9) AS total FROM f GROUP BY decade""",
    "ols_baseline": f"SELECT outcome, round(coef, 9) AS coef, round(intercept, 9) AS intercept, round(r2, 9) AS r2, round(se_ols, 9) AS se_ols, round({_t_p('coef / se_ols', 'n - 2')}, 9) AS p, round(coef - {_t_end('n - 2')} * se_ols, 9) AS low, round(coef + {_t_end('n - 2')} * se_ols, 9) AS high, n FROM ({MACRO} SELECT outcome, regr_slope(y, x) AS coef, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, sqrt((regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS se_ols, count(*) AS n FROM p GROUP BY outcome)",
    "hc3": f"SELECT outcome, round(coef, 9) AS coef, round(se_hc3, 9) AS se_hc3, round({_t_p('coef / se_hc3', 'n - 2')}, 9) AS p FROM ({MACRO}, {_OLS} SELECT outcome, max(b) AS coef, sqrt(sum((xt * e / (1 - 1 / cnt - xt * xt / sxx)) ** 2)) / max(sxx) AS se_hc3, count(*) AS n FROM r GROUP BY outcome)",
    "breusch_pagan": f"SELECT outcome, round(lm, 9) AS bp_lm, round({_chi2_p('lm', 1)}, 9) AS bp_lm_p, round(f, 9) AS bp_f, round({_f_p('f', '1', 'n - 2')}, 9) AS bp_f_p FROM (SELECT outcome, n, n * r2 AS lm, r2 / ((1 - r2) / (n - 2)) AS f FROM ({MACRO}, {_OLS} SELECT outcome, regr_r2(e * e, x) AS r2, count(*) AS n FROM r GROUP BY outcome))",
    "hac_raw": _hac(MACRO),
    "hac_trend": _hac(MACRO, ("t",)),
    "hac_decade": _hac(MACRO, (), "decade"),
    "hac_small_sample": f"SELECT outcome, round(coef, 9) AS coef, round(se, 9) AS se, round({_t_p('coef / se', 'n - 2')}, 9) AS p, round(coef - 1.96 * se, 9) AS low, round(coef + 1.96 * se, 9) AS high FROM ({_hac(MACRO, factor='count(*) / (count(*) - 2)', select='coef, se, n')})",
    "durbin_watson": f"SELECT a.outcome, round(a.dw, 9) AS dw_raw, round(b.dw, 9) AS dw_decade FROM ({_hac(MACRO, select='dw')}) a JOIN ({_hac(MACRO, (), 'decade', select='dw')}) b ON a.outcome = b.outcome",
    "hac_interaction_1973": _hac(f"{MACRO}, pp AS (SELECT *, x * post AS x_post, x * (1 - post) AS x_pre FROM p)", ("t", "post", "x_pre"), x="x_post", source="pp", select="round(coef, 9) AS coef, round(se, 9) AS se"),
    "macro_controls": _macro_controls(),
    "fe_advertiser_cluster": f"""{BASE}, {SECTORED}, {STATED}, {RATIO}, d AS (SELECT brand_key, year, y - avg(y) OVER w AS yt, CAST(state AS INTEGER) - avg(CAST(state AS INTEGER)) OVER w AS xt FROM stt JOIN ry USING (row_id) WINDOW w AS (PARTITION BY brand_key)),
      b AS (SELECT sum(xt * yt) / sum(xt * xt) AS b, sum(xt * xt) AS sxx, count(*) AS n FROM d), g AS (SELECT year, sum(xt * (yt - b * xt)) AS s FROM d, b GROUP BY year), k AS (SELECT count(*) AS g, sum(s * s) AS s2 FROM g)
      SELECT round(b, 9) AS coef, round(sqrt(s2 * g / (g - 1) * (n - 1) / (n - 1)) / sxx, 9) AS se, n, g AS clusters FROM b, k""",
    "fe_two_way_cluster": _two_way(),
    "fe_decade_sector": _two_way("sector"),
    "fe_switchers": f"""{BASE}, {SECTORED}, {STATED}, {RATIO}, sw AS (SELECT brand_key FROM stt GROUP BY 1 HAVING count(*) >= 2 AND bool_or(state) AND NOT bool_and(state)), d AS (SELECT brand_key, year, y - avg(y) OVER w AS yt, CAST(state AS INTEGER) - avg(CAST(state AS INTEGER)) OVER w AS xt FROM stt JOIN ry USING (row_id) JOIN sw USING (brand_key) WINDOW w AS (PARTITION BY brand_key)),
      b AS (SELECT sum(xt * yt) / sum(xt * xt) AS b, sum(xt * xt) AS sxx, count(*) AS n FROM d), g AS (SELECT year, sum(xt * (yt - b * xt)) AS s FROM d, b GROUP BY year), k AS (SELECT count(*) AS g, sum(s * s) AS s2 FROM g)
      SELECT round(b, 9) AS coef, round(sqrt(s2 * g / (g - 1) * (n - 1) / (n - 1)) / sxx, 9) AS se, n, g AS clusters FROM b, k""",
    "year_range": "SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS yq, count(*) AS orders FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY 1",
    "segmented_words": rf"""WITH {ADS}, t AS (SELECT decade, list_filter(regexp_extract_all(lower(text), '{_WORD_RULE}'), lambda w: regexp_matches(w, '\p{{L}}')) AS w FROM ads)
      SELECT decade, CAST(sum(len(w)) AS BIGINT) AS words, CAST(sum(len(list_filter(w, lambda x: regexp_matches(x, '[''.:\x{{2019}}]')))) AS BIGINT) AS marked, CAST(sum(len(list_filter(w, lambda x: regexp_matches(x, '[0-9]')))) AS BIGINT) AS with_digits FROM t GROUP BY decade""",
    "measure_discovery": f"WITH {ADS}, {', '.join(_scores(v, 's_' + v) for v in _VARIANTS)}, {', '.join(_series('macro', 's_' + v, 'q_' + v) for v in _VARIANTS)}, st AS (SELECT yq, harvard_neg AS value FROM q_no_stopwords), c AS ({' UNION ALL '.join(f"SELECT '{v}_{o}_ratio' AS candidate, (SELECT max(CASE WHEN (q.{o} IS NULL) <> (st.value IS NULL) THEN CAST('Infinity' AS DOUBLE) ELSE abs(q.{o} - st.value) END) FROM q_{v} q FULL JOIN st USING (yq)) AS max_error, (SELECT count(*) FROM q_{v} JOIN st USING (yq)) AS points" for v in _VARIANTS for o in OUT)}) SELECT candidate, round(max_error, 9) AS max_error, points, max_error < 1e-6 AND points > 0 AS chosen FROM c",
    "checked_labels": f"WITH {ADS}, {VERSIONS}, {LABELLED} SELECT decade, count(*) AS labelled, count(*) FILTER (non_ad) AS non_ads, count(*) FILTER (v3 = non_ad) AS agree FROM l GROUP BY decade",
    "letter_words": rf"WITH {ADS}, t AS (SELECT decade, len(regexp_extract_all(lower(text), '\p{{L}}+')) AS n FROM ads) SELECT decade, CAST(sum(n) AS BIGINT) AS words, max(n) AS longest FROM t GROUP BY decade",
    "holm": f"""WITH o AS (SELECT l_suppkey AS s_suppkey, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total, stddev_samp(CAST(round(l_extendedprice * 100) AS BIGINT)) AS sd FROM lineitem GROUP BY 1),
      z AS (SELECT s_suppkey, (total / n - (SELECT CAST(sum(total) AS BIGINT) / CAST(sum(n) AS BIGINT) FROM o)) / (sd / sqrt(n)) AS coef, 1.0 AS se FROM o WHERE n > 1 AND sd > 0), p AS (SELECT s_suppkey, round({_NORMAL_P}, 9) AS p FROM z)
      SELECT s_suppkey, p, round(least(1, max((m - i + 1) * p) OVER (ORDER BY p, s_suppkey ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p, s_suppkey) AS i, count(*) OVER () AS m FROM p)""",
    "blocklist_rederived": f"WITH {ADS}, l AS (SELECT row_id, trim(coalesce(brand, '')) AS b FROM ads) SELECT row_id, b IN {_in(BLOCKLIST)} AS listed, lower(b) IN (SELECT lower(b) FROM l WHERE b IN {_in(BLOCKLIST)}) AS named FROM l",
    "caught_by_reason": f"WITH {ADS}, {VERSIONS}, {LABELLED} SELECT CASE WHEN b.toxic = 1 THEN 'toxic' ELSE 'other' END AS reason, count(*) AS non_ads, count(*) FILTER (NOT v3) AS missed FROM l JOIN labels b ON l.row_id = b.doc_id WHERE non_ad GROUP BY 1",
    "audit_excerpts": f"""WITH {ADS}, h AS (SELECT row_id, {_HITS} FROM ads WHERE row_id NOT IN (SELECT doc_id FROM labels)), u AS ({' UNION ALL '.join(f'SELECT {_q(r)} AS rule, row_id FROM h WHERE rule_{r}' for r in RULES)}),
      d AS (SELECT rule, row_id FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY md5('314:' || rule || ':' || row_id), row_id) AS k FROM u) WHERE k <= 30),
      m AS (SELECT rule, row_id, t, CASE rule {' '.join(f'WHEN {_q(k)} THEN regexp_extract(t, {_any(p)})' for k, p in RULES.items())} END AS matched FROM d JOIN (SELECT row_id, {_N} AS t FROM ads) USING (row_id))
      SELECT rule, row_id, matched, substr(t, greatest(strpos(t, matched) - 150, 1), 600) AS excerpt FROM m""",
    "model_grid": f"SELECT {_GRID_KEY}, {_r(['coef', 'se', 'p', 'mean_y', 'pct_of_mean', 'ci_low_pct', 'ci_high_pct'])}, n FROM ({_GRID})",
    "ladder": f"""SELECT outcome, level, spec, version, {_r(['pct_of_mean', 'ci_low_pct', 'ci_high_pct', 'p'])}, n, round(max(pct_of_mean) FILTER (version = 'v3') OVER w - max(pct_of_mean) FILTER (version = 'none') OVER w, 9) AS shift
      FROM ({_GRID}) WHERE version IN ('none', 'v3') AND (level = 'ad' OR (aggregation = 'macro' AND definition = 'majority')) WINDOW w AS (PARTITION BY outcome, level, spec)""",
    "holm_models": f"SELECT {_GRID_KEY}, round(p, 9) AS p, round(least(1, max((m - i + 1) * p) OVER (ORDER BY p, {_GRID_KEY} ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM (SELECT *, row_number() OVER (ORDER BY p, {_GRID_KEY}) AS i, count(*) OVER () AS m FROM ({_GRID}))",
    "hac_interaction_decade": _hac(f"{MACRO}, pp AS (SELECT *, x * post AS x_post, x * (1 - post) AS x_pre FROM p)", ("post", "x_pre"), "decade", x="x_post", source="pp", select="round(coef, 9) AS coef, round(se, 9) AS se"),
    "composition_hac": _hac(
        f"""WITH {ADS}, {CAL}, {SECTORED}, lr AS (SELECT brand_key, count(DISTINCT year) >= 10 AS lr FROM sec GROUP BY 1),
      cs AS (SELECT yq, count(*) AS ads, count(DISTINCT brand_key) AS advertisers, avg(CAST(lr AS INTEGER)) AS long_running_share, count(*) / count(DISTINCT brand_key) AS ads_per_advertiser, {', '.join(f'count(*) FILTER (sector = {_q(s)}) / count(*) AS {s.lower()}' for s in [*[s for s, _ in SECTORS], 'Other'])} FROM sec JOIN lr USING (brand_key) GROUP BY yq),
      p AS (SELECT yq, outcome, y, CAST(recession_majority AS INTEGER) AS x FROM ({' UNION ALL '.join(f"SELECT yq, '{c}' AS outcome, CAST({c} AS DOUBLE) AS y FROM cs" for c in ['ads', 'advertisers', 'ads_per_advertiser', 'long_running_share', *[s.lower() for s, _ in SECTORS], 'other'])}) JOIN cal USING (yq))""",
        select=f"round(coef, 6) AS coef, round(se, 6) AS se, n, round({_NORMAL_P}, 6) AS p",
    ),
    "shift_share_pooled": f"""{BASE}, {SECTORED}, {STATED}, {RATIO}, d AS (SELECT decade, sector, state, y FROM stt JOIN ry USING (row_id)),
      tot AS (SELECT decade, count(*) FILTER (state) AS tr, count(*) FILTER (NOT state) AS te FROM d GROUP BY 1 HAVING tr > 0 AND te > 0),
      c AS (SELECT decade, sector, count(*) FILTER (state) AS nr, count(*) FILTER (NOT state) AS ne, avg(y) FILTER (state) AS mr, avg(y) FILTER (NOT state) AS me FROM d GROUP BY 1, 2),
      f AS (SELECT decade, tr, nr / tr AS wr, ne / te AS we, coalesce(mr, me) AS mr, coalesce(me, mr) AS me FROM c JOIN tot USING (decade)),
      ds AS (SELECT max(tr) AS w, sum((wr - we) * (mr + me) / 2) AS b, sum((wr + we) / 2 * (mr - me)) AS i FROM f GROUP BY decade), z AS (SELECT sum(w * b) / sum(w) AS b, sum(w * i) / sum(w) AS i FROM ds)
      SELECT round(b, 9) AS "between", round(i, 9) AS within, round(b + i, 9) AS total, CASE WHEN abs(b + i) >= 0.005 THEN round(b / (b + i), 9) END AS mix_share FROM z""",
    "rules_beyond_v2": f"WITH {ADS}, {VERSIONS} SELECT decade, count(*) AS n, count(*) FILTER (v3 AND NOT v2) AS n_new FROM v GROUP BY decade",
    "rule_excerpts": f"WITH {ADS} SELECT row_id, x AS excerpt FROM (SELECT row_id, regexp_extract(text, {_q('(?is).{0,150}(?:' + '|'.join(RULES['licence']) + ').{0,150}')}) AS x FROM ads) WHERE x <> ''",
    "second_coder": f"WITH {ADS}, {STRATA}, {_drawn('st')} SELECT row_id, decade, stratum FROM dr ORDER BY md5('2718:' || row_id), row_id LIMIT 30",
    "drift_vs_gap": f"{MACRO}, m AS (SELECT outcome, decade, avg(y) AS m FROM p GROUP BY 1, 2), d AS (SELECT outcome, max(m) - min(m) AS drift_range, stddev_samp(m) AS drift_sd FROM m GROUP BY 1), g AS ({_gap('p', 'outcome', 'x = 1')}) SELECT outcome, {_r(['drift_range', 'drift_sd'])}, round(100 * gap / mean_y, 9) AS pct_of_mean FROM d JOIN g USING (outcome)",
    "vocab_bow": rf"""WITH {ADS}, k AS (SELECT row_id, unnest(list_transform(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z]{{3,}}')), lambda w: lower(w))) AS word FROM ads), t AS (SELECT * FROM k WHERE word NOT IN {_in(STOPWORDS)}),
      s AS (SELECT word, count(DISTINCT row_id) AS df, count(*) AS tf FROM t GROUP BY word), top AS (SELECT * FROM s WHERE df >= 20 AND df <= 0.5 * (SELECT count(DISTINCT row_id) FROM t) ORDER BY tf DESC, word LIMIT 5000) SELECT word, df, tf, row_number() OVER (ORDER BY word) - 1 AS index FROM top""",
    "word_freq_by_decade": f"WITH {ADS}, t AS (SELECT decade, {CWORDS} FROM ads) SELECT decade, word, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 50",
    "fightin_words": f"WITH {ADS}, {CAL}, {STATED_ADS}, base AS (SELECT decade, recession, word, count(*) AS n FROM (SELECT decade, recession, {CWORDS} FROM sa) GROUP BY ALL), {_odds('base', '')} SELECT word, round(delta, 9) AS delta, round(z, 9) AS z FROM lo",
    "vocab_concentration": f"WITH {ADS}, c AS (SELECT yq, word, count(*) AS n FROM (SELECT yq, {CWORDS} FROM ads) GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY yq) AS words, row_number() OVER (PARTITION BY yq ORDER BY n DESC, word) AS r FROM c) SELECT yq, word AS top_word, n AS top_count, CAST(words AS BIGINT) AS words, round(n / words, 9) AS top_share FROM t WHERE r = 1",
    "daily_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "row_alignment": f"WITH {ADS}, b AS (SELECT row_id + 1 AS label_id, brand AS label_brand FROM ads) SELECT 'less_one' AS key, round(avg(CAST(brand IS NOT DISTINCT FROM label_brand AS INTEGER)), 9) AS rate FROM ads JOIN b ON row_id = label_id - 1 UNION ALL SELECT 'same', round(avg(CAST(brand IS NOT DISTINCT FROM label_brand AS INTEGER)), 9) FROM ads JOIN b ON row_id = label_id",
    "brand_counts": f"WITH {ADS} SELECT brand, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM ads GROUP BY brand",
    "topic_overlap": f"WITH {ADS}, c AS (SELECT decade, word, count(*) AS n FROM (SELECT decade, {CWORDS} FROM ads) GROUP BY ALL), t AS (SELECT decade, list(word) AS ws FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY decade ORDER BY n DESC, word) <= 10) GROUP BY decade) SELECT a.decade, len(list_intersect(a.ws, b.ws)) AS shared, round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))), 9) AS jaccard FROM t a JOIN t b ON a.decade + 10 = b.decade",
}

#: The shuffles 0 to 3 and the observed labels; all 500 would take SQL too long.
FOUR_SHUFFLES = f"""WITH {ADS}, {CAL}, {STATED_ADS}, base AS (SELECT yq, decade, recession, word, count(*) AS n FROM (SELECT yq, decade, recession, {CWORDS} FROM sa) GROUP BY ALL),
      qs AS (SELECT DISTINCT yq, decade, recession FROM base), lab AS (SELECT perm, yq, row_number() OVER (PARTITION BY perm, decade ORDER BY md5('42:' || perm || ':' || yq), yq) <= count(*) FILTER (recession) OVER (PARTITION BY perm, decade) AS recession FROM qs, (SELECT unnest([0, 1, 2, 3]) AS perm)
        UNION ALL SELECT -1, yq, recession FROM qs),
      cnt AS (SELECT perm, decade, lab.recession, word, sum(n) AS n FROM base JOIN lab USING (yq) GROUP BY ALL), {_odds('cnt', 'perm')} SELECT CAST(perm AS BIGINT) AS perm, round(max(abs(z)), 9) AS max_z FROM lo GROUP BY perm"""
