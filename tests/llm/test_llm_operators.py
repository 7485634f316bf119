import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import SCHEMA, brute_components, brute_removed, documents, frame, shingles
from tidemark.llm import brown, decontaminate, jaccard_join, main_text, pieces, quality_pu, quality_rules, repeats, secrets, toxicity
from tidemark.llm.shingles import Sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0), int(i % 4 == 0)) for i in range(1, 200)] + [(None, 1, 1), (4, 1, None)], "doc_id bigint, quality int, toxic int")


def plain():
    return [(r[0], r[1]) for r in documents()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple("" if x is None else str(x) for x in r))


# 7
def test_quality_counts(docs, labels):
    want = []
    for i, t in plain():
        w = WORD.findall(t or "")
        windows = list(zip(w, w[1:], w[2:]))
        n = collections.Counter(windows)
        inside = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside), failed))
    got = quality_rules.quality_report(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert ordered(map(tuple, got.collect())) == ordered(want)


def test_quality_stage_keeps_columns_and_empty(docs, labels, empty):
    out = quality_rules.quality_rules(docs, labels, into="_verdict")
    assert out.columns == [*docs.columns, "_verdict"] and out.count() == docs.count()
    assert quality_rules.quality_report(empty, labels).count() == 0
    assert quality_rules.quality_report(docs, labels.limit(0)).count() == docs.count()


def test_bands_join_where_labels_are_few(spark):
    of = lambda n: spark.range(1).select(quality_rules._strata(F.array(*[F.lit(x).cast("long") for x in n]), 100).alias("s")).first().s
    assert of([100, 100, 100, 100]) == [0, 1, 2, 3]
    assert of([100, 100, 60, 60]) == [0, 1, 2, 2]
    assert of([100, 100, 60, 30]) == [0, 1, 1, 1]
    assert of([10, 20, 30, 20]) == [0, 0, 0, 0]
    assert of([0, 150, 0, 100]) == [0, 0, 1, 1]


def test_stated_risk_holds(spark):
    # Good documents of 16 strata all follow one law: a rule may lose more than alpha of them in a share delta of the corpora.
    rng = np.random.default_rng(31)
    alpha, delta = 0.05, 0.1
    law = lambda n: rng.binomial(10_000, rng.beta(1, 12, n)) / 10_000
    truth, lost = law(200_000), []
    schema = "doc_id bigint, _quality struct<words: struct<n_words: bigint, word_chars: bigint, n_repeat_words: bigint>, lines: struct<n_lines: bigint, n_dup_lines: bigint>, n_symbols: bigint, n_capitals: bigint, n_bangs: bigint>"
    labels = spark.createDataFrame([(i, 1) for i in range(1600)], "doc_id bigint, quality int")
    for _ in range(4):
        rows = [(i, ((n, 10_000, 0), (1, 0), int(v * 10_000), 0, 0)) for i, (n, v) in enumerate(zip([100, 300, 900, 3000] * 400, law(1600)))]
        cuts = quality_rules.joint_cutoffs(spark.createDataFrame(rows, schema), labels, alpha, delta).collect()
        assert len(cuts) == 4
        lost += [float((truth > r.cuts["symbols"]).mean()) for r in cuts if "symbols" in r.cuts]
    assert len(lost) >= 8 and sum(x > alpha for x in lost) <= 2


def test_repeated_and_contradicting_labels_are_one_trial_or_none(spark):
    rows = [(i % 10, " ".join(f"w{k}" for k in range(100))) for i in range(600)]
    d = quality_rules.measured(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert quality_rules.joint_cutoffs(d, spark.createDataFrame([(i, 1) for i in range(10)], "doc_id bigint, quality int")).count() == 0
    rows = [(i, " ".join(f"w{k}" for k in range(100))) for i in range(600)]
    d = quality_rules.measured(spark.createDataFrame(rows, "doc_id bigint, text string"))
    both = spark.createDataFrame([(i, q) for i in range(600) for q in (0, 1)], "doc_id bigint, quality int")
    assert quality_rules.joint_cutoffs(d, both).count() == 0
    assert quality_rules.joint_cutoffs(d, both.filter("quality = 1")).count() == 4


def test_binomial_tail(spark):
    r = spark.range(1).select(quality_rules.binomial_tail(F.lit(3), F.lit(50), 0.1).alias("p")).first().p
    assert r == pytest.approx(sum(math.comb(50, k) * 0.1**k * 0.9 ** (50 - k) for k in range(4)), rel=1e-12)


# 1
def test_secrets(spark):
    key = hashlib.sha256(b"k").hexdigest()
    token = "Zx9Qp2Lm7Rt4Vb8Nc1Ks6Wd3Hf5Jg0Ty"
    rows = [(1, f'a PASSWORD = "{key[:20]}" é'), (2, "AKIA" + "Q7" * 8), (3, None), (4, ""), (5, "secret: short"), (6, f"x {token}{token[::-1]} y"), (7, "einfachsehrlangeswortohneziffern " * 3), (1, "deadbeefdeadbeef")]
    got = [tuple(r) for r in secrets.secret_report(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_assign", "n_access", "n_hex", "spans").collect()]
    by = {(i, s): (a, b, c) for i, a, b, c, s in got}
    assert by[(1, "assign:2:34,hex:14:34")] == (1, 0, 1)
    assert by[(2, "access:0:20")] == (0, 1, 0)
    assert by[(3, "")] == by[(4, "")] == by[(5, "")] == by[(7, "")] == (0, 0, 0)
    assert by[(6, "random:2:66")] == (0, 0, 0)
    assert by[(1, "hex:0:16")] == (0, 0, 1)


def test_battery_tells_random_from_regular():
    rng = random.Random(2)
    alphabet = dict((n, a) for n, a in secrets.ALPHABETS)["base62"]
    passed = sum(secrets.battery("".join(rng.choice(alphabet) for _ in range(40)))["joint"] > 0.01 for _ in range(300))
    assert passed > 280
    assert secrets.battery("abababababababababababab1")["joint"] < 1e-3
    for plain in ("internationalisierungsgesetz", "SomeVeryLongCamelCaseName2021", "usr-local-share-documentation"):
        assert secrets.battery(plain)["joint"] < 1e-2


def test_false_discoveries_are_controlled_by_length():
    # Random keys of each encoding among glued words: most keys are found, few words are.
    rng = random.Random(22)
    null = secrets.drawn_bins()
    vocabulary = ["".join(rng.choices(list(secrets.FREQUENT), list(secrets.FREQUENT.values()), k=rng.randrange(3, 11))) for _ in range(3000)]
    for name, low in (("base62", 0.9), ("base64", 0.85), ("lower", 0.6), ("upper", 0.6), ("base32", 0.45)):
        alphabet = dict(secrets.ALPHABETS)[name]
        for n in (40, 64):
            keys = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(300)]
            words = [secrets.glued(rng.sample(vocabulary, 40), k % 4, n, k) for k in range(700)]
            cells = [[tuple(secrets.cell(x).values()) for x in part] for part in (keys, words)]
            last = secrets.reported_bins(collections.Counter(c for part in cells for c in part), null, 0.01)
            hits = [sum(k <= last.get((b, c), -1) for b, c, k in part) for part in cells]
            assert hits[0] >= low * 300 and hits[1] <= 0.03 * (hits[0] + hits[1]), (name, n, hits)


def brute_base(text):
    """The three patterns by a scan from each place."""
    text, spans = text or "", []
    body = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < len(text):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if text[i : i + len(name)].lower() == name and text[i : i + len(name)].isascii():
                for quote in (1, 0):
                    j = i + len(name)
                    if quote and text[j : j + 1] not in ('"', "'"):
                        continue
                    j += quote
                    while text[j : j + 1] == " ":
                        j += 1
                    if text[j : j + 1] in (":", "=") and text[j : j + 1]:
                        j += 1
                        while text[j : j + 1] == " ":
                            j += 1
                        j += text[j : j + 1] in ('"', "'") and bool(text[j : j + 1])
                        k = j
                        while k < len(text) and text[k] in body:
                            k += 1
                        if k > j:
                            if k - j >= 12:
                                spans.append((i, 0, k))
                            i = k - 1
                        break
                break
        i += 1
    for kind, first, chars, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18), (2, "", set("0123456789abcdef"), 16)):
        i = 0
        while i < len(text):
            k = i + len(first)
            if text.startswith(first, i):
                while k < len(text) and text[k] in chars:
                    k += 1
            if k > i + len(first):
                if k - i >= least:
                    spans.append((i, kind, k))
                i = k
            else:
                i += 1
    return sorted(spans)


def test_base_spans_by_brute_force():
    rng = random.Random(23)
    parts = ["password", "PassWD", "secret", "token", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "AKIA", "0123456789abcdef", "deadbeef", "Zz9+/_.=-", "QWERTY123456", "é", "x", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert secrets.base_spans(text) == brute_base(text), text


def test_long_runs_take_linear_time():
    import time

    began = time.time()
    for text in ("1" * 1_000_000, "." * 1_000_000, "a1" * 500_000, "token " * 150_000, ("deadbeefdeadbeef " + "Q" * 30 + " ") * 20_000):
        secrets._scan([text])
        toxicity.features(text, {"aa*": 1.0})
    assert time.time() - began < 60


def test_redaction(docs, empty):
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert secrets.redact(empty).count() == 0
    assert [r.text is None for r in out.filter("doc_id = 1").collect()] == [True]


# 5
def test_pieces_round_trip_and_best_path(spark, docs, empty):
    v = pieces.load()
    texts = [t or "" for _, t in plain()]
    for t, ids in zip(texts, pieces.encode_texts(v, texts)):
        assert pieces.decode_ids(v, ids) == t
    rng = random.Random(3)
    sample = [t[:60] for t in texts if t] + ["".join(rng.choice("ab é日😀\n▁") for _ in range(30)) for _ in range(30)]
    by_bytes = {bytes(v.flat[v.offset[i] : v.offset[i + 1]]): None for i in range(len(v.score))}
    assert len(by_bytes) > 30_000
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(len(v.score)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    for t, ids in zip(sample, pieces.encode_texts(v, sample)):
        marked = (pieces.MARK + t).replace(" ", pieces.MARK)
        best = [0.0] + [-math.inf] * len(marked)
        for k in range(1, len(marked) + 1):
            best[k] = max(best[j] + score.get(marked[j:k], v.unknown if k - j == 1 else -math.inf) for j in range(max(0, k - 20), k))
        pos, total = 0, 0.0
        ids = ids.tolist()
        while ids:
            if sp.is_byte(ids[0]):  # a character's bytes cost one unknown
                n = len(marked[pos].encode())
                total, ids, pos = total + v.unknown, ids[n:], pos + 1
            else:
                total, pos, ids = total + v.score[ids[0]], pos + len(sp.id_to_piece(ids[0])), ids[1:]
        assert pos == len(marked) and total == pytest.approx(best[-1], rel=1e-12)
    out = pieces.encoded_documents(docs)
    assert out.count() == docs.count() and out.filter("not round_trip").count() == 0 and out.filter("ids is null").count() == 1
    assert pieces.encoded_documents(empty).count() == 0
    back = pieces.decode(pieces.encode(docs, into="codes"), ids="codes").filter("not (text <=> decoded)")
    assert back.count() == 0


# 9
def test_brown_base_and_model(docs, empty):
    rows = plain()
    count, n_docs = collections.Counter(), 0
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            count.update((t or "").encode().lower().split())
            n_docs += 1
    total, types = sum(count.values()) + n_docs, len(count) + 1
    log = lambda c: math.log10((c + 0.5) / (total + 0.5 * (types + 1)))
    want = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        want.append((i, len(w) + 1, sum(count[x] > 0 for x in w) + 1, total, sum(log(count[x]) for x in w) + log(n_docs)))
    # The score, word by word, from the vocabulary's classes alone.
    train = docs.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1).select("text")
    vocabulary = {bytes(r.word): (r.n, r["class"]) for r in brown.fit_classes(train, 6, 3)[0].collect()}
    assert {w: n for w, (n, _) in vocabulary.items()} == count and all((k == 3) == (n == 1 and w not in [x for x, _ in count.most_common(6)]) for w, (n, k) in vocabulary.items())
    size = collections.Counter()
    for n, k in vocabulary.values():
        size[k] += n
    once = sum(k == 3 for _, k in vocabulary.values())
    path = lambda t: [5, *[vocabulary.get(w, (0, 3))[1] for w in (t or "").encode().lower().split()], 4]
    pairs = collections.Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            pairs.update(zip(path(t), path(t)[1:]))
    after, before = collections.Counter(), collections.Counter()
    for (x, y), n in pairs.items():
        before[x] += n
        after[y] += n
    types = collections.Counter(x for x, _ in pairs)
    share = {y: (after[y] + 1e-3) / (sum(after.values()) + 5e-3) for y in range(5)}

    def model(t):
        out = sum(math.log10((pairs[x, y] + max(1, types[x]) * share[y]) / (before[x] + max(1, types[x]))) for x, y in zip(path(t), path(t)[1:]))
        for w in (t or "").encode().lower().split():
            n, k = vocabulary.get(w, (0, 3))
            out += math.log10((n + 0.5) / (size[3] + 0.5 * (once + 1))) if k == 3 else math.log10(n / size[k])
        return out

    scores = [(*x, model(t)) for x, (_, t) in zip(want, rows)]
    for head in (brown.HEAD, 7, 0):  # the join with the tail gives the same as the dictionary alone
        got = brown.brown_scores(docs, seeds=6, classes=3, head=head).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
        for x, y in zip(ordered(map(tuple, got)), ordered(scores), strict=True):
            assert x[:4] == y[:4] and x[4:] == pytest.approx(y[4:], rel=1e-9)
    assert brown.brown_scores(empty).count() == 0


def test_gains_are_differences_of_likelihood():
    rng = np.random.default_rng(18)
    k, words = 3, 14  # classes 0 to 2, the shared one 3, the end 4 and the start 5
    own = np.concatenate([rng.integers(0, 3, 8), np.full(words - 8, 3), [4, 5]])
    pairs = rng.integers(0, 5, (words + 2, words + 2))
    pairs[words], pairs[:, words + 1] = 0, 0
    w = 10
    pairs[w, w] = 0

    def grid(kinds):
        one = np.eye(k + 3)[kinds]
        return one.T @ pairs @ one

    def likelihood(kinds):
        g = grid(kinds)
        f = lambda x: float(brown._xlogx(x).sum())
        return f(g) - f(g.sum(1)) - f(g.sum(0))

    counts = np.concatenate([np.bincount(own, pairs[w], k + 3), np.bincount(own, pairs[:, w], k + 3)])
    found = brown.gains(grid(own), np.stack([counts, counts * 0, counts]), k)
    assert np.allclose(found[0], found[2]) and np.allclose(found[1], 0)
    found = found[0]
    moved = []
    for b in range(k):
        kinds = own.copy()
        kinds[w] = b
        moved.append(likelihood(kinds))
    # What leaving the shared class costs is the same for all classes.
    assert np.allclose(np.array(moved) - moved[0], found - found[0])


def test_exchange_finds_classes():
    rng = random.Random(4)
    pairs = np.zeros((9, 9), np.int64)
    for _ in range(4000):  # words 0-2 and 3-5 follow each other in turn
        a = rng.randrange(3)
        pairs[a, 3 + rng.randrange(3)] += 1
        pairs[3 + rng.randrange(3), rng.randrange(3)] += 1
    own = brown.exchange(pairs, 2)
    assert len(set(own[:3])) == 1 and len(set(own[3:6])) == 1 and own[0] != own[3]
    assert np.allclose((10 ** brown.transition_logs(pairs.astype(float) + 1)).sum(1), 1.0)


# 4 and 8
def synthetic(n):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 7 == 0, i % 5 == 0
        words = [rng.choice("stone river cloud lamp quiet paper green".split()) for _ in range(80)]
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(6):
                words[rng.randrange(80)] = rng.choice(["idiot", "moron", "scum"])
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_classifiers(spark, docs, empty, labels):
    rows, lab = synthetic(1500)
    d, lab_df = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(lab, "doc_id bigint, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in lab}
    for scores, at in ((quality_pu.quality_scores(d, lab_df), 0), (toxicity.toxicity_scores(d, lab_df), 1)):
        got = [r for r in scores.collect() if r.held_out and r.doc_id in truth]
        assert np.mean([r.predicted == truth[r.doc_id][at] for r in got]) > 0.97
        assert all(0 <= r.score <= 1 for r in got)
    for f in (quality_pu.quality_scores, toxicity.toxicity_scores):
        assert f(docs, labels).count() == docs.count()
        assert f(empty, labels.limit(0)).count() == 0


def test_isotonic_rises():
    x = np.random.default_rng(0).random(200)
    k, v = toxicity.isotonic(x, (x + np.random.default_rng(1).normal(0, 0.3, 200) > 0.5).astype(float))
    assert (np.diff(v) >= 0).all() and (np.diff(k) >= 0).all()


def test_prior_estimate():
    rng = np.random.default_rng(0)
    p, n = rng.normal(2, 1, (4000, 2)), rng.normal(-2, 1, (1200, 2))
    u = np.concatenate([rng.normal(2, 1, (2800, 2)), n])
    assert quality_pu.estimate_prior(p, u) == pytest.approx(0.7, abs=0.06)


# 6
@pytest.mark.parametrize(("words", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
@pytest.mark.parametrize(("hot", "wide"), [(2, 3), (2, 4096), (32, 4096)])
def test_jaccard(docs, words, num, den, hot, wide, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "WIDE", wide)
    rows = [(i, t) for i, t in plain() if i is not None]
    want = brute_components(rows, words, num, den)
    got = jaccard_join.jaccard_components(docs, words, num, den).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: len(shingles(t, words)) for i, t in rows}
    assert len(got) == docs.count() and [r.component_id for r in got if r.doc_id is None] == [None]


def test_jaccard_loses_no_link_without_leaders():
    # Every similar pair of random sets shares a signature, many empty segments or not.
    rng = random.Random(7)
    for num in (50, 80, 90):
        plan = jaccard_join.Plan(num, 100)
        texts = []
        for _ in range(150):
            base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))]
            for _ in range(3):
                texts.append(" ".join(w if rng.random() > 0.08 else f"v{rng.randrange(10**6)}" for w in base).encode())
        s = Sets(texts, 1)
        sig, own, _ = jaccard_join.signatures(s, plan, np.arange(len(texts)))
        groups = collections.defaultdict(set)
        for a, b in zip(sig.tolist(), own.tolist()):
            groups[b].add(a)
        for i in range(len(texts)):
            for j in range(i - i % 3, i):
                x, y = set(s.of(i).tolist()), set(s.of(j).tolist())
                if x and x != y and 100 * len(x & y) >= num * len(x | y):
                    assert groups[i] & groups[j]


def test_sketches_lose_no_link():
    import pyarrow as pa

    rng = random.Random(26)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 20, 100, 126, 260, 900]))]
        for _ in range(4):
            texts.append(" ".join(w for w in base if rng.random() > 0.06).encode())
    s = Sets(texts, 1)
    full = np.flatnonzero(s.size)
    shown = jaccard_join.sketches(s)
    table = pa.table({"leader": np.zeros(len(full), np.int64), "node": s.key[full], "size": s.size[full], "sketch": pa.array([shown[k] for k in full], pa.binary())})
    for num in (80, 90):
        group = {}
        for a, b in zip(*(jaccard_join.near_groups(table, num, 100)[c].to_pylist() for c in ("leader", "member"))):
            assert a < b
            group[b] = a
        linked = 0
        for i in full:
            for j in full:
                x, y = set(s.of(i).tolist()), set(s.of(j).tolist())
                if x != y and 100 * len(x & y) >= num * len(x | y):
                    linked += 1
                    a, b = int(s.key[i]), int(s.key[j])
                    assert group.get(a, a) == group.get(b, b)
        assert linked and len(set(group.values())) > 20


def test_hot_signatures_lose_no_link():
    # Only sets with more hot and empty segments than their role allows may look into hot groups.
    rng = random.Random(21)
    line = [f"line{k}" for k in range(40)]
    for num in (80, 90):
        plan = jaccard_join.Plan(num, 100)
        texts = []
        for _ in range(60):
            base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 160))] + line
            for _ in range(3):
                texts.append(" ".join(w if rng.random() > 0.05 else f"v{rng.randrange(10**6)}" for w in base).encode())
        s = Sets(texts, 1)
        sig, own, role = jaccard_join.signatures(s, plan, np.arange(len(texts)))
        often = collections.Counter(sig.tolist())
        cold, hot, count = collections.defaultdict(set), collections.defaultdict(set), collections.Counter()
        for a, b, r in zip(sig.tolist(), own.tolist(), role.tolist()):
            cold[b].add(a) if often[a] <= 4 else count.update([(b, r)])
        for a, b, r in zip(sig.tolist(), own.tolist(), role.tolist()):
            if often[a] > 4 and count[b, r] > r // 2 - 1:
                hot[b].add(a)
        for i in range(len(texts)):
            for j in range(i):
                x, y = set(s.of(i).tolist()), set(s.of(j).tolist())
                if x != y and 100 * len(x & y) >= num * len(x | y):
                    assert cold[i] & cold[j] or hot[i] & hot[j]


def _members(n, shared, own, size=200):
    """Members of one leader that all differ from it by `shared` shingles in common and `own` of their own."""
    import pyarrow as pa

    common = np.arange(1, shared + 1, dtype=np.uint64)
    diffs = [np.concatenate([common, np.arange(own, dtype=np.uint64) + np.uint64(10**6 + k * own)]).tobytes() for k in range(n)]
    return pa.table({"leader": np.zeros(n, np.int64), "member": np.arange(n), "size": np.full(n, size), "linked": np.zeros(n, bool), "diff": pa.array(diffs, pa.binary())})


@pytest.mark.parametrize(("shared", "own", "links"), [(60, 2, 49_999), (1, 70, 0)])
def test_many_members_of_one_leader(shared, own, links):
    import time

    began = time.time()
    assert jaccard_join.links_beside(_members(50_000, shared, own), 80, 100).num_rows == links
    assert time.time() - began < 60


def test_one_of_each(docs, empty):
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns
    want = brute_components([(i, t) for i, t in plain() if i is not None], 5, 80, 100)
    assert {r.doc_id for r in out.collect()} == {i for i in want if want[i] == i} | {None}
    assert jaccard_join.one_of_each(empty).count() == 0


# 2
def removed(d, rows, width):
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeat_report(d, width).collect())
    want = brute_removed(rows, width)
    assert got == collections.Counter((i, len((t or "").encode()), n, runs, hashlib.sha256(kept).hexdigest()) for (i, t), (n, runs, kept) in zip(rows, want))
    return want


@pytest.mark.parametrize("width", [50, 20])
def test_repeats(spark, width, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET", 3000)
    # Ids that repeat with equal and other texts, and null ids.
    rng = random.Random(14)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base, a, b = noise(600), noise(470), noise(300)
    rows = [*plain(), (10_001, base), (10_005, base + " " + a), (10_005, b), (10_005, b), (None, base), (None, a + "zz" + b), (None, noise(200)), (10_004, a[:200])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    removed(d, rows, width)


def test_repeats_with_single_ids(spark):
    rows = [(i, t) for i, t in dict(plain()).items() if i is not None]
    assert sum(x[0] for x in removed(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), rows, 50)) > 0


def test_previous_factors():
    rng = np.random.default_rng(17)
    for n in (1, 2, 9, 300):
        doc, lcp = rng.integers(0, 9, n), rng.integers(0, 6, n)
        lcp[0] = 0
        want = []
        for i in range(n):
            best = 0
            for way in (-1, 1):
                low, j = 99, i
                while 0 <= j + way < n:
                    low = min(low, lcp[j] if way < 0 else lcp[j + 1])
                    j += way
                    if doc[j] < doc[i]:
                        best = max(best, low)
                        break
            want.append(best)
        assert repeats.previous_factors(doc, lcp).tolist() == want
    doc = np.arange(200_000)[::-1].copy()  # no smaller document for miles
    assert not repeats.smaller_before(doc, np.full(200_000, 5)).any()


def test_repeats_edges(docs, empty):
    out = repeats.repeat_report(docs)
    assert out.count() == docs.count() and repeats.repeat_report(empty).count() == 0
    last = out.filter("doc_id is null").first()  # a null id comes after all others
    assert last.n_removed == last.n_bytes


# 3
def test_main_text(spark):
    html = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>Menu</a></ul></nav>"
        '<div class="cookie-notice">We use cookies to make this site work for you.</div><main><article><h1>Rivers &amp; stones</h1><p>The first paragraph is long enough to be text,\n with a line feed.<br>And more.'
        "<p>A <b>second</b> one &mdash; it says things about stones.</p><aside>Related: see our other stories about rivers.</aside><script>var x = '</p>';</script></article></main>"
        '<section id="comments"><p>Reader: I think that this is a very good text indeed, thank you.</p></section><form><input><button>Send</button></form><footer>&copy; 2020 Someone</footer></bo'
    )
    want = "Rivers & stones The first paragraph is long enough to be text, with a line feed. And more. A second one — it says things about stones."
    rows = [(1, "u", html), (2, "u", None), (3, None, ""), (None, "u", "<p"), (1, "u", html)]
    got = main_text.page_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert ordered(tuple(r) for r in got.collect()) == ordered([(1, "u", want, len(want))] * 2 + [(2, "u", "", 0), (3, None, "", 0), (None, "u", "", 0)])


def test_blocks_match_their_chains():
    # The running sums against chains written out, on random markup.
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        """Only tags that close nothing else: chains of (element, number), one for each text."""

        def __init__(self):
            super().__init__()
            self.stack, self.chains, self.n = [], [], 0

        def handle_starttag(self, tag, attrs):
            self.n += 1
            self.stack.append((tag, self.n, main_text._bias(tag, dict(attrs))))

        def handle_endtag(self, tag):
            names = [t for t, _, _ in self.stack]
            if tag in names:
                del self.stack[len(names) - 1 - names[::-1].index(tag) :]

        def handle_data(self, data):
            self.chains.append(list(self.stack))

    rng = random.Random(24)
    for _ in range(60):
        html = "".join(rng.choice(["<div class='content'>", "<section id=sidebar>", "<nav>", "<article>", "</div>", "</section>", "</nav>", "</article>", "<blockquote>"]) + f"text {k}." for k in range(40))
        plain = Plain()
        plain.feed(html)
        plain.close()
        blocks = main_text.blocks_of(html)
        assert len(blocks) == len(plain.chains)
        for k, (b, chain) in enumerate(zip(blocks, plain.chains)):
            assert b["depth"] == len(chain) and b["against"] == sum(min(0, e[2]) for e in chain) and b["best"] == max([0.0, *(e[2] for e in chain)])
            assert b["parent"] == (chain[-2][1] if len(chain) > 1 else 0)
            before = plain.chains[k - 1] if k else []
            assert not k or b["shared"] == sum(x[1] == y[1] for x, y in zip(chain, before))


def test_pages_without_telling_names(spark):
    # No class or id words: element names, links, length and the cut alone.
    story = [f"Sentence number {k} of the story says something about stones, rivers and the long way between them." for k in range(12)]
    page = "<html><body><div><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></div><div><h1>Title of it</h1>" + "".join(f"<p>{x}</p>" for x in story) + "</div><div><ul>" + "".join(f"<li><a href=/{k}>Other page {k}</a></li>" for k in range(9)) + "</ul></div></body></html>"
    text = main_text.main_text(page)
    assert all(x in text for x in story) and "Other page" not in text and "Home" not in text
    assert main_text.page_texts(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    clash = main_text.extract(spark.createDataFrame([(1, page, "x", 2)], "page_id bigint, html string, text string, n_chars int"))
    assert clash.columns == ["page_id", "html", "text", "n_chars", "_main"] and clash.first()._main.text == text


def test_deep_markup_takes_linear_time():
    import time

    began = time.time()
    for html in ("<div>x" * 100_000, "<b>" * 50_000 + "x</i>" * 50_000, "<p><span>y" * 50_000, "<li>z" * 100_000, "<div class=nav>a</div><p>A sentence that stays here.</p>" * 30_000):
        main_text.main_text(html)
    assert time.time() - began < 60


def test_min_cut_is_minimal():
    rng = random.Random(8)
    for _ in range(40):
        n = 7
        w = [rng.uniform(-2, 2) for _ in range(n)]
        links = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cut = lambda side: sum(x for x, s in zip(w, side) if x > 0 and not s) - sum(x for x, s in zip(w, side) if x < 0 and s) + sum(c for a, b, c in links if side[a] != side[b])  # noqa: B023, E731
        best = min(cut([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cut(main_text.source_side(w, links)) == pytest.approx(best)


# 10
@pytest.mark.parametrize("shard", [7, decontaminate.SHARD])
def test_leaks(spark, docs, empty, shard, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", shard)
    monkeypatch.setattr(decontaminate, "SHARDS", 2)
    monkeypatch.setattr(decontaminate, "BLOCK", 4)
    rng = random.Random(9)
    items = [(k, " ".join(f"t{rng.randrange(300)}" for _ in range(rng.randrange(12, 60)))) for k in range(40)] + [(40, "tiny item"), (41, None), (42, "")]
    texts = []
    for i in range(60):
        w = [f"t{rng.randrange(300)}" for _ in range(200)]
        if i % 3 == 0:
            at, own = rng.randrange(150), items[i % 40][1].split()
            if i % 2:
                own[len(own) // 2] = "changed"
            w[at:at] = own
        texts.append((i, " ".join(w)))
    texts += [(60, "see the tiny item here"), (61, None), (60, "see the tiny item here")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(texts, "doc_id bigint, text string"), bench).collect())
    want = collections.Counter()
    for i, t in texts:
        w = decontaminate.words_of(t)
        for k, item in items:
            own = decontaminate.words_of(item)
            g = decontaminate.grams(own)
            n = min(5, len(own))
            have = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
            if g and len(g & have) >= 0.8 * len(g):
                want[i, k] += 1
    assert got == want and sum(want.values()) > 15
    clash = spark.createDataFrame([(60, "see the tiny item here", 5)], "doc_id bigint, text string, _leaks int")
    clash = decontaminate.with_leaks(clash, bench, decontaminate.fresh(clash, "_leaks"))
    assert [x.item_id for x in clash.select(clash.columns[-1]).first()[0]] == [40]
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_retrieval_is_the_whole_scan():
    rng = random.Random(25)
    items = [(k, [f"t{int(rng.expovariate(0.03))}" for _ in range(rng.randrange(1, 60))]) for k in range(400)]
    index = decontaminate.index_of(items)
    df = collections.Counter(t for _, w in items for t in set(w))
    mean = sum(len(w) for _, w in items) / len(items)
    for _ in range(150):
        passage = {f"t{int(rng.expovariate(0.03))}" for _ in range(rng.randrange(1, 90))} & set(index.terms)
        want = set()
        for j, (_, w) in enumerate(index.items):
            score = sum(math.log(1 + (400.5 - df[t]) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(w) & passage)
            if score >= index.goal[j]:
                want.add(j)
        assert {j for j, _ in index.retrieved(np.array([index.terms[t] for t in passage], np.int64))} == want


def test_threshold_loses_no_overlap():
    # Twelve frequent words and eight rare ones, the last three rare ones altered: 13 of 16 grams, about 5/8 of the score.
    common = [f"c{k}" for k in range(12)]
    items = [(k, common + [f"rare{k}x{j}" for j in range(8)]) for k in range(30)]
    df = collections.Counter(t for _, w in items for t in w)
    idf = {t: math.log(1 + (30.5 - n) / (n + 0.5)) for t, n in df.items()}
    index = decontaminate.Index(items, idf, 20.0, 20)
    got = index.search(["before"] * 30 + items[7][1][:17] + ["other"] * 30)
    assert [(r["item_id"], r["overlap"]) for r in got] == [(7, 13 / 16)]
    # The bound lies below every accepted set of grams, tried one by one.
    rng = random.Random(11)
    for n in (3, 5, 9, 14, 16):
        w = [f"t{rng.randrange(12)}" for _ in range(n)]
        weight = {t: rng.random() for t in set(w)}
        g = sorted(decontaminate.grams(w))
        sums = [sum(weight[t] for t in set().union(*(x for k, x in enumerate(g) if m >> k & 1))) for m in range(1 << len(g)) if m.bit_count() >= 0.8 * len(g)]
        assert 0 < decontaminate.least_score(w, weight) <= min(sums) + 1e-9


def test_question_alone_is_a_leak(spark):
    rng = random.Random(12)
    items = [(k, [f"i{k}w{j}" for j in range(24)]) for k in range(5)]
    filler = lambda n: [f"f{rng.randrange(900)}" for _ in range(n)]
    texts = [filler(50) + items[1][1][:18] + filler(50), filler(50) + items[2][1] + filler(50), filler(50) + items[3][1][18:] + filler(50), filler(120)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.overlap, r.question, r.answer, r.kind) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(0, 1, 0.7, 1.0, 0.0, "question"), (1, 2, 1.0, 1.0, 1.0, "whole")]


def test_query_rejects_junk(spark, tmp_path):
    # 500 good documents of one band: too few for separate bounds, enough for a joint one.
    from tidemark.llm.queries import op7_quality_rules

    rng = random.Random(13)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" + ("%%%" if i >= 500 else "") for _ in range(100))) for i in range(560)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(500)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id: r.kept for r in op7_quality_rules(spark, str(tmp_path)).collect()}
    assert len(kept) == 560 and not any(kept[i] for i in range(500, 560))
    assert sum(not kept[i] for i in range(500)) <= 0.02 * 500
    # With too few labels nothing is proven.
    few = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id bigint, quality int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all(r.kept for r in quality_rules.quality_report(docs, few).collect())


# Markup that a page's end cuts off, deep runs of inline elements and the like must not cost more than its length.
@pytest.mark.parametrize("html", ["<div " * 200_000, "<!--" * 250_000, "<em><div>" + "<span>" * 60_000 + "</em>" * 60_000, "<a b='" * 150_000, "<" * 500_000, "<script>" * 100_000], ids=["tags", "comments", "inline", "quotes", "signs", "scripts"])
def test_broken_markup_is_read_in_one_pass(html):
    import time

    began = time.process_time()
    main_text.main_text(html)
    assert time.process_time() - began < 5


def test_markup():
    got = list(main_text.markup("a &lt; b<P class='x y' hidden id=z>t</p><br/><!-- <b> --><!x><?y?>1 < 2<script>if (a<b) {}</script>end<i"))
    assert got == [
        ("text", "a < b"), ("start", "p", {"class": "x y", "hidden": None, "id": "z"}, False), ("text", "t"), ("end", "p"), ("start", "br", {}, True),
        ("text", "1 <"), ("text", " 2"), ("start", "script", {}, False), ("end", "script"), ("text", "end"),
    ]
    assert [g for g in main_text.markup("x<!-- cut <b>y</b>")] == [("text", "x"), ("text", "y"), ("end", "b")]
    assert [g for g in main_text.markup("<!-->z<!--->w")] == [("text", "z"), ("text", "w")]


def test_clashing_names(spark, labels):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)), 1, 2, 3, 4) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _cut_band int, _cuts int, _gone int, _leaks int")
    ruled = quality_rules.quality_rules(docs, labels, into="_verdict")
    assert ruled.columns == [*docs.columns, "_verdict"] and ruled.count() == 4
    assert jaccard_join.one_of_each(docs).count() == 4
    items = spark.createDataFrame([(1, " ".join(f"w2x{k}" for k in range(20)))], "item_id long, text string")
    found = decontaminate.with_leaks(docs, items)
    assert found.columns == [c for c in docs.columns if c != "_leaks"] + ["_leaks"]
    assert {r.doc_id: len(r._leaks) for r in found.collect()} == {0: 0, 1: 0, 2: 1, 3: 0}


def test_scores_do_not_depend_on_shards(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"v{k}" for k in range(80)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(8, 30))) for _ in range(40)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(["pad"] * (i % 7) + [t] + ["end"] * 9)) for i, t in enumerate(texts)], "doc_id long, text string")

    def found(size):
        monkeypatch.setattr(decontaminate, "SHARD", size)
        return sorted(tuple(r) for r in decontaminate.leaks(docs, items).collect())

    whole = found(8192)
    assert len(whole) >= 40
    for size in (1, 7, 25):
        assert [r[:2] for r in found(size)] == [r[:2] for r in whole]
        for a, b in zip(found(size), whole):
            assert a[2:6] == pytest.approx(b[2:6]) and a[6] == b[6]


def test_wand_gives_what_a_full_search_gives():
    """Against scores of all items; postings are passed over, and the index can be sent after use."""
    import pickle

    rng, tally = random.Random(1), collections.Counter()
    for _ in range(30):
        words = [f"w{k}" for k in range(rng.choice([30, 200, 2000]))]
        odds = [1 / (k + 1) for k in range(len(words))]
        items = [(i, rng.choices(words, odds, k=rng.randrange(3, 60))) for i in range(rng.choice([5, 150, 700]))]
        index = decontaminate.index_of(items)
        for _ in range(12):
            own = rng.choice(items)[1]
            asked = own[: rng.randrange(1, len(own) + 1)] + rng.choices(words, odds, k=rng.randrange(40))
            terms = np.array(sorted({index.terms[w] for w in asked if w in index.terms}), np.int64)
            score = np.zeros(len(items))
            for t in terms.tolist():
                at = slice(index.first[index.of_term[t]], index.last[index.of_term[t + 1] - 1])
                score[index.item[at]] += index.impact[at]
            want = [(j, x) for j, x in enumerate(score) if x > 0 and x >= index.goal[j]]
            got = index.retrieved(terms, tally)
            assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])
        assert pickle.loads(pickle.dumps(index)).retrieved(terms) == index.retrieved(terms)
    assert index.retrieved(np.zeros(0, np.int64)) == []
    assert tally["passed"] > tally["scored"] / 10
