import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from mapframe.llm import language_model as lm
from mapframe.llm import pii, quality

LOWER = {c: c + 32 for c in range(65, 91)}
DATA = "/root/testdata/sf0.01"

# --- language model


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2


def base_rows(rows):
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [""]
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return Counter((d, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for d, t in rows)


def got_rows(frame):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in frame.collect())


def test_op4(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    made = lm.op4_language_model(spark, DATA).cache()
    assert got_rows(made) == base_rows(rows)
    gain = made.where("held_out").agg((F.sum("score") - F.sum("base_score")) / F.sum("n_tokens"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert gain[0] > 0.1 and gain[1] > 0.9  # on texts that nothing was learnt from


def test_language_model_of_odd_rows(spark):
    long = "x" * 100_000
    rows = [(1, "A b b\n c"), (2, None), (3, ""), (None, "b"), (None, "q"), (4, "a b c d e f " * 50), (4, long + " b"), (9, long + " b")] + [(i, f"{long} b w{i % 3}") for i in range(20, 50)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, score int")
    for hot in (1 << 19, 3, 0):
        assert got_rows(lm.score_documents(frame, quality.remainder("doc_id", 7) == 2, hot=hot)) == base_rows(rows)
    assert lm.score_documents(frame.limit(0), quality.remainder("doc_id", 7) == 2).count() == 0


def small_model(texts):
    """The vocabulary of a few texts, its counts, and random weights."""
    tokens = lm.Tokens(pa.array(texts))
    counts = np.bincount(tokens.codes, minlength=tokens.end + 1)
    tokens_of, types_of = np.bincount(tokens.classes, weights=counts, minlength=lm.CLASSES), np.bincount(tokens.classes, minlength=lm.CLASSES)
    keys = tokens.keys.to_pylist()
    chosen = [(k, c) for k, c in enumerate(tokens.classes.tolist()) if counts[k] > 2]
    slots = [sum(c == d for _, d in chosen[:i]) for i, (_, c) in enumerate(chosen)]
    known = lm.Vocabulary(tokens_of, types_of, [keys[k] for k, _ in chosen], np.array([c for _, c in chosen]), np.array(slots), counts[[k for k, _ in chosen]])
    return known, dict(zip(keys, counts.tolist())), np.random.default_rng(1).normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)


def test_probabilities_of_all_words_sum_to_one():
    texts = ["a b c a b a", "un deux trois un un deux " * 3, "one of the many of the one " * 4, None, "d"]
    known, counts, weights = small_model(texts)
    spelled = sorted({w for t in texts if t for w in t.split()})
    unknown, k = {}, 0
    while len(unknown) < lm.CLASSES - 1:  # one word never seen in each class; the end alone is in class 0
        unknown.setdefault(int(lm.Tokens(pa.array([f"x{k}q"])).classes[0]), f"x{k}q")
        k += 1
    for history in ("", "one of ", "trois zz "):
        tokens = lm.Tokens(pa.array([history + w for w in [*spelled, *unknown.values()]] + [history.strip()]))
        log, plain = lm.factors(weights, tokens, known)
        n = np.array([counts.get(x, 0) for x in tokens.keys.to_pylist()])[tokens.codes]
        p = 10**log * np.where(plain, (n + 1) / known.rest[tokens.classes[tokens.codes]], 1)
        at = np.append(tokens.offsets[1:-1] - 2, tokens.offsets[-1] - 1)  # the last word of each text; of the last one, its end
        assert abs(p[at].sum() - 1) < 1e-5


def test_descent_lowers_the_loss():
    texts = ["un deux trois quatre " * 50, "one two three four " * 50]
    known, _, weights = small_model(texts)
    weights = np.zeros_like(weights)
    weights[lm.BIAS] = known.start
    tokens = lm.Tokens(pa.array(texts))
    loss = lambda: -lm.factors(weights, tokens, known)[0].mean()
    before = loss()
    for _ in range(30):
        lm.descend(weights, np.zeros(lm.ROWS), np.full(lm.ROWS, 0.05), tokens, known, 0.25)
    assert loss() < before / 3


def test_sums_of_runs_and_softmax_against_brute_force():
    rng = np.random.default_rng(5)
    h = np.sort(np.concatenate([rng.integers(0, 50, 400), np.full(300, 7), np.arange(60, 80)])).astype(np.uint16)
    values, order = rng.normal(size=(len(h), lm.CLASSES)).astype(np.float32), rng.permutation(len(h))
    at, starts, many = np.unique(h, return_index=True, return_counts=True)
    want = np.stack([values[order[h == x]].astype(float).sum(axis=0) for x in at])
    assert np.allclose(lm._sums(values, order, starts, many), want, atol=1e-3)
    x, chosen = (rng.normal(size=(200, lm.SLOTS)) * rng.choice([1, 60], (200, 1))).astype(np.float32), rng.integers(0, lm.SLOTS, 200)
    exact = x.astype(float) - x.max(axis=1, keepdims=True)
    exact = (exact - np.log(np.exp(exact).sum(axis=1, keepdims=True)))[np.arange(200), chosen]
    assert np.allclose(lm.log_chosen(x.copy(), chosen), exact, atol=1e-3)


# --- quality


def test_op7_on_held_out_labels(spark):
    rated = quality.op7_quality(spark, "/root/testdata/sf0.1").cache()
    assert rated.count() == 10_000 and rated.where("score < 0 or score > 1 or score is null").count() == 0
    told = rated.where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    assert told.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.97
    assert rated.where("held_out <> (crc32(cast(doc_id as string)) % 5 = 0) or predicted <> cast(score >= 0.3 as int)").count() == 0


def test_linear_time_identity():
    rng = np.random.default_rng(2)
    machine = quality.Machine(50, 3)
    machine.w, machine.w0 = rng.normal(size=50).astype(np.float32), 0.3
    machine.v = rng.normal(size=(50, 3)).astype(np.float32)
    numbers, weights = rng.permutation(50)[:12], rng.random(12).astype(np.float32)
    want = machine.w0 + sum(machine.w[i] * x for i, x in zip(numbers, weights))
    want += sum(float(machine.v[numbers[a]] @ machine.v[numbers[b]]) * weights[a] * weights[b] for a in range(12) for b in range(a))
    assert np.isclose(machine.raw(numbers, weights, np.array([0, 12]))[0][0], want, rtol=1e-4)


def score_of(text, machine):
    """The score by its definition: features a word at a time, all pairs."""
    raw, words = (text or "").encode(), re.findall(r"[^\x20\x09-\x0D]+", text or "")
    share = lambda many, times: min(1, times * many / max(len(raw), 1))
    w, lines, some = max(len(words), 1), raw.count(b"\n") + 1, lambda pattern: len(re.findall(pattern, raw))
    up, low = some(rb"[A-Z]"), some(rb"[a-z]")
    numbers = [math.log2(1 + len(words)) / 16, math.log2(lines) / 12, up / max(up + low, 1), share(some(rb"[!-+\-/:-@\[-`{-~]"), 4), share(some(rb"[0-9]"), 8), share(some(rb"[\x80-\xff]"), 1)]
    numbers += [sum(a == b for a, b in zip(words, words[1:])) / w, len(set(words)) / w, min(1, len(raw) / w / 24), min(1, w / lines / 200)]
    hashed = sorted({xxhash.xxh64_intdigest(x.translate(LOWER).encode(), 7) % quality.BUCKETS for x in words})
    at = hashed + [quality.BUCKETS + 12 * k + min(11, int(x * 12)) for k, x in enumerate(numbers)]
    x = np.array([1 / math.sqrt(max(len(hashed), 1))] * len(hashed) + [1.0] * 10)
    v = machine.v[at].astype(float) * x[:, None]
    return 1 / (1 + math.exp(-(machine.w0 + machine.w[at] @ x + np.triu(v @ v.T, 1).sum())))


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(6)
    machine = quality.Machine()
    machine.w0, machine.w = -0.2, rng.normal(0, 0.3, len(machine.w)).astype(np.float32)
    machine.v = rng.normal(0, 0.15, machine.v.shape).astype(np.float32)
    texts = [None, "", " \n\t", "A a a B!", "é É 日本\n1,2.3 [x] {y}~", "word " * 30_000, "z" * 200_000, " ".join(f"W{k % 900}" for k in range(20_000)) + "\n" * 5000]
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts += [r.text for r in rows]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.scored(frame, machine, ["doc_id"]).collect():
        assert abs(r.score - score_of(texts[r.doc_id], machine)) < 1e-4


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", 0), (2, None, 0), (3, "", 0), (None, "x", 0), (1, "good words here", 0), (6, "W!! " * 20_000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (6, 0), (None, 1), (3, None), (77, 1)], "doc_id long, quality int")
    made = quality.scored(docs, quality.fit(docs, labels))
    assert made.columns == ["doc_id", "text", "score"] and made.where("score is null").count() == 0 and made.count() == 6
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, none, ["doc_id"]).collect()} != set() and quality.scored(docs.limit(0), none).count() == 0


# --- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def passes(kind, span):
    digits = re.sub("[^0-9]", "", span)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in span.split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def established(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text or "") if passes(kind, m[0]))


TEXTS = ["a@b.c_d@e.f", "x@y z a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 12", "+1 (499) 555-6503.", "+1", "+12345678901234567", "🙂🙂 a.b@c.de é +49 30 1234567", "a@b.c.@x.y", "--@-.-", "1-1-1 4111111111111111", "", None, "9 " * 3000, "a@b.cc " * 1500, "1 " * 20_000, "x" * 100_000 + "@y.z", "no data at all, 2024-01-31, 10 000 000, v1.2.3"]


def test_pii(spark):
    frame = spark.createDataFrame([(k, t, 0) for k, t in enumerate([*TEXTS, TEXTS[5]])], "doc_id long, text string, base int")
    made = pii.spans(frame).collect()
    assert {r.doc_id: [tuple(s) for s in r.base] for r in made} == {k: established(t) for k, t in enumerate([*TEXTS, TEXTS[5]])}
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in made)
    assert [tuple(s) for r in made if r.doc_id == 20 for s in r.spans] == []
    assert pii.spans(frame.limit(0)).count() == 0


def test_pii_adds_what_the_base_rules_miss(spark):
    cases = {"call (555) 123-4567 now": (5, 3, 19), "mail anna at foo dot com": (5, 0, 24), "card 4111.1111.1111.1111": (5, 2, 24), "tel 555-123-4567": (4, 3, 16), "ip 2001:db8::ff00:42": (3, 1, 20)}
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.text: [tuple(s) for s in r.spans] for r in pii.spans(frame).collect()} == {t: [s] for t, s in cases.items()}
    clean = spark.createDataFrame([(1, "version 1.2.3 of 2024-01-31, order 555-123-4567, pages 1990-1995, ISBN 978-3-1614-8410-0, at 12:30:45")], "doc_id long, text string")
    assert pii.spans(clean).first().spans == []


def test_op1_digests(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    import hashlib

    for r in pii.op1_pii(spark, "/root/testdata/sf0.001").collect():
        base = established(rows[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[1] for x in base) for k in range(4))
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and (not listed or listed in r.spans or len(r.spans) > len(listed))


def test_pii_is_native_and_redacts(spark):
    frame = spark.createDataFrame([(1, "🙂 a.b@c.de é +49 30 1234567!"), (2, "none")], "doc_id long, text string")
    plan = pii.redacted(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert [r.text for r in pii.redacted(frame).orderBy("doc_id").collect()] == ["🙂 [EMAIL] é [PHONE]!", "none"]


def test_pii_finds_numbers_beside_others(spark):
    cases = {"visa 4111 1111 1111 1111 12/26": "4111 1111 1111 1111", "card 4111.1111.1111.1111 12/26": "4111.1111.1111.1111"}
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {r.text: [r.text[x[0] : x[2]] for x in r.spans] for r in pii.spans(frame).collect()} == {t: [s] for t, s in cases.items()}


def test_selection_against_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = []
    for k in range(60):
        spread = rng.choice([20, 60, 400])
        some = lambda n: [(a := rng.randrange(spread), rng.randrange(4), a + rng.randint(1, 9)) for _ in range(n)]
        rows.append((k, sorted(set(some(rng.randrange(4)))), [(rng.choice([0.5, 1.0, 1.5, 2.0]), *x) for x in some(rng.randrange(0, 40))]))
    long = [(1.0 + i % 3, 10 * i, 3, 10 * i + 9 + i % 2) for i in range(3000)]
    rows.append((100, [], long))
    want = {}
    for k, base, more in rows:
        chosen = []
        for m, a, kind, b in sorted(more, key=lambda x: (-x[0], *x[1:])):
            if not any(a < d and c < b for c, _, d in base + chosen):
                chosen.append((a, kind, b))
        want[k] = sorted(base + chosen)
    frame = spark.createDataFrame(rows, "k int, base array<struct<start:bigint,kind:int,end:bigint>>, more array<struct<margin:double,start:bigint,kind:int,end:bigint>>")
    got = frame.select("k", pii.selected(F.col("base"), F.col("more")).alias("s")).collect()
    assert {r.k: [tuple(x) for x in r.s] for r in got} == want


def test_time_follows_the_number_of_spans(spark):
    import time

    def seconds(n):
        frame = spark.createDataFrame([(1, " and ".join(f"tel +49 30 {k:07d}" for k in range(n)))], "doc_id long, text string")
        began = time.time()
        assert pii.spans(frame).select(F.size("spans")).first()[0] == n
        return time.time() - began

    seconds(500)
    few, many = min(seconds(4000) for _ in range(2)), min(seconds(32_000) for _ in range(2))
    assert many < 20 * few  # 64 times, if every span were held against every other


#: Spans that no template of the examples makes: (text, what it holds).
PLANTED = [
    ("Please phone our office on 0171 234 5678 before noon.", "0171 234 5678"), ("mobile: 07700 900123, ask for the night shift", "07700 900123"),
    ("You may ring (020) 7946-0958 at any hour", "(020) 7946-0958"), ("fax 030/1234567 stays on", "030/1234567"),
    ("My cell is 212.555.0187 these days", "212.555.0187"), ("write to mary.ann at mail dot example", "mary.ann at mail dot example"),
    ("contact j.doe [at] corp [dot] org soon", "j.doe [at] corp [dot] org"), ("reach bob(at)shop(dot)com", "bob(at)shop(dot)com"),
    ("credit card 5500_0000_0000_0004 was declined", "5500_0000_0000_0004"), ("visa 4012/8888/8888/1881", "4012/8888/8888/1881"),
    ("server fe80::1ff:fe23:4567:890a answered", "fe80::1ff:fe23:4567:890a"), ("host 10[.]20[.]30[.]40 is down", "10[.]20[.]30[.]40"),
    ("The year 2024 saw 1 250 000 visitors in 12 towns.", ""), ("See section 4.2.1, pages 100-112, of volume 7.", ""),
    ("It ran from 08:30 to 17:45 on 12/05/2023.", ""), ("Order 4711-0815-42 ships in 3-5 days.", ""), ("ISBN 0-306-40615-2 is out of print", ""),
    ("Look at the dot on the map at point seven", ""), ("They met at dawn. Dot waved.", ""), ("scores of 21-19, 18-21 and 21-15", ""),
    ("about 3.14159 or 2.71828, whichever fits", ""), ("MAC 00:1B:44:11:3A:B7 of the port", ""), ("chapter 10 verse 12 line 144", ""),
]


def test_trees_on_spans_planted_apart_from_the_examples(spark):
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(PLANTED)], "doc_id long, text string")
    found = {r.doc_id: [r.text[x.start : x.end] for x in r.spans] for r in pii.spans(frame).collect()}
    right = sum(found[k] == [want] for k, (_, want) in enumerate(PLANTED) if want)
    false = sum(len(found[k]) for k, (_, want) in enumerate(PLANTED) if not want)
    print("planted:", right, "of", sum(bool(w) for _, w in PLANTED), "false:", false, found)
    assert false == 0 and right >= 6
