import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mapframe.llm import decontamination, line_dedup, simhash
from mapframe.llm.components import components
from mapframe.llm.hashing import xxh64
from tests.oracle import same

LOWER = {c: c + 32 for c in range(65, 91)}
DATA = "/root/testdata/sf0.001"


def test_xxh64_in_columns():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 50_000, dtype=np.uint8)
    lengths = np.concatenate([np.repeat(np.arange(0, 100), 50), np.array([256, 257, 1000])])
    starts = rng.integers(0, len(data) - 1000, len(lengths))
    assert [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(starts, lengths)] == xxh64(data, starts, lengths, 42).tolist()


# --- decontamination


def test_op5_matches_sql(spark):
    assert same(spark, decontamination.op5_decontamination, decontamination.ORACLE_SQL) == 200


def hits(text, items, size=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (body or "").translate(LOWER))
        if item is None or not w:
            continue
        n = min(size, len(w))
        for k in range(len(w) - n + 1):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_decontamination_of_odd_rows(spark, monkeypatch, most):
    monkeypatch.setattr("mapframe.llm.decontamination.fits", lambda df: bool(most))
    monkeypatch.setattr("mapframe.llm.common.LEAST_SPREAD", 512 if most else 4)
    monkeypatch.setattr("mapframe.llm.decontamination._CHUNK", 2048 if most else 3)
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["a", "B", "c-d", "é", "7"]) for _ in range(n))
    items = [(1, "a b c"), (2, words(25)), (2, words(12)), (10, None), (None, "a b"), (3, "..."), (4, "É é é"), (5, "a b c"), (6, words(9))]
    docs = [(k, words(rng.randint(0, 60)), 0) for k in range(40)] + [(90, None, 0), (91, "", 0), (92, items[1][1] + " x " + items[1][1], 0), (92, items[2][1], 0), (None, "a, b! c", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_words int")
    got = decontamination.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((d, *hits(t, items)) for d, t, _ in docs), key=str)
    empty = decontamination.contamination(frame, spark.createDataFrame([], "item_id long, text string"), ["doc_id"])
    assert empty.where("contaminated").count() == 0 and empty.count() == len(docs)
    assert decontamination.contamination(frame.limit(0), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).count() == 0


def test_decontamination_of_few_words_and_long_texts(spark):
    """A vocabulary of two words: nearly every place of a text proposes many windows."""
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(k, say(30)) for k in range(12)] + [(50, "z " * 3000)]
    docs = [(0, say(6000)), (1, "z " * 20_000 + "é"), (2, "c " * 30_000), (3, say(9))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontamination.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    places = lambda t, size=10: [" ".join(w) for w in zip(*(t.split()[k:] for k in range(size)))]
    windows = {w for _, t in items for w in places(t)}
    for d, t in docs:
        hit = {k for i, w in enumerate(places(t)) if w in windows for k in range(i, i + 10)}
        owners = sorted(str(i) for i, x in items if set(places(x)) & set(places(t)))
        row = next(r for r in got if r.doc_id == d)
        assert (row.n_words, row.n_hit, row.n_items, row.items_sha256) == (len(t.split()), len(hit), len(owners), hashlib.sha256(",".join(owners).encode()).hexdigest())
    kept = decontamination.without_contaminated(frame.withColumn("_own_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.contaminated} == {2, 3} and kept.columns == ["doc_id", "text", "_own_id"]


def test_bit_tables_know_their_keys(spark):
    keys = np.random.default_rng(2).integers(0, 1 << 64, 5000, dtype=np.uint64)
    table = decontamination.bits_of(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "h long").repartition(3), 5000)
    assert table.maybe(keys).all() and table.maybe(np.random.default_rng(3).integers(0, 1 << 64, 50_000, dtype=np.uint64)).mean() < 0.01


# --- SimHash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def clusters(rows):
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 4):
            label[root(i)] = root(int(i + 1 + j))
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[root(i)] = min(first.get(root(i), d), d)
    return Counter((d, f"{prints[i]:016x}", first.get(root(i))) for i, (d, _) in enumerate(rows))


def test_op9(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert Counter(map(tuple, simhash.op9_simhash(spark, DATA).collect())) == clusters(rows)


@pytest.mark.parametrize("group", [8192, 16])
def test_simhash_of_odd_rows(spark, group):
    rng = random.Random(2)
    base = [rng.choice("abcdefghij") * 3 for _ in range(400)]
    rows = [(i, " ".join(x if rng.random() > 0.003 else "zz" for x in base)) for i in range(300)]
    rows += [(i, f"w{i // 2} x y z q") for i in range(300, 340)] + [(None, "p q"), (None, "p q"), (7, None), (8, ""), (9, " \t\n"), (7, "a b c d e"), (5, "É x 日本"), (5, "É x 日本")]
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(30_000))
    rows += [(400, long), (401, long + " more"), (402, "y" * 200_000), (403, "Y" * 200_000 + "\n")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(frame, group=group).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    want = clusters(rows)
    assert Counter(map(tuple, got.collect())) == want
    kept = simhash.one_of_each(frame, group=group)
    assert kept.columns == frame.columns and kept.count() == len({(c, f if c is None else 0) for _, f, c in want}) + 1  # two components have the id 7
    assert simhash.near_duplicates(frame.limit(0)).count() == 0 and simhash.one_of_each(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [10, 1 << 21, 1 << 27, 1 << 40])
def test_every_pair_within_the_radius_shares_a_key(spark, n):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 64, 200, dtype=np.uint64)
    b = a.copy()
    for k in range(200):
        for bit in rng.choice(64, 4, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    frame = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a.view(np.int64), b.view(np.int64))], "a long, b long")
    assert frame.where(F.arrays_overlap(simhash.keys(F.col("a"), n, 4), simhash.keys(F.col("b"), n, 4))).count() == 200


def test_a_large_cell_is_searched_one_by_one(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, [base[k % 3] ^ (np.uint64(1) << np.uint64(k % 64)) ^ (np.uint64(1) << np.uint64(k * 7 % 64)) for k in range(200)]]))
    cell = np.repeat([5, 9], [len(fp), 30]), np.concatenate([fp, base[:30]])

    def parts(found):
        label = {int(x): int(x) for x in cell[1]}
        for a, b in zip(*found):
            assert label[int(a)] != label[int(b)]
            old, new = sorted((label[int(a)], label[int(b)]), reverse=True)
            label = {k: new if v == old else v for k, v in label.items()}
        return label

    monkeypatch.setattr(simhash, "LARGE", 1 << 40)
    want = parts(simhash._spanning(*cell, 4))
    monkeypatch.setattr(simhash, "LARGE", 2)
    assert parts(simhash._spanning(*cell, 4)) == want and len(set(want.values())) < len(fp) - 50


def test_hot_roots_and_hubs_are_dealt(spark, monkeypatch):
    monkeypatch.setattr("mapframe.llm.common.LEAST_SPREAD", 3)
    edges = [(0, k) for k in range(1, 200)] + [(500, 501)]
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == {**{k: 0 for k in range(200)}, 500: 500, 501: 500}
    rows = [(k, "all the same words here " + ("x" if k % 50 == 0 else "")) for k in range(200)] + [(300, "one two three four five")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got.collect()) == clusters(rows)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300), (-5, -9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 200: 200, 201: 200, 202: 200, -5: -9, -9: -9}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- line dedup


def test_op10_matches_sql(spark):
    assert same(spark, line_dedup.op10_line_dedup, line_dedup.ORACLE_SQL) == 200


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


@pytest.mark.parametrize("edits", [0, 1])
def test_line_dedup_of_odd_rows(spark, edits):
    rng = random.Random(5)
    lines = [" ".join(rng.choice("ab") for _ in range(rng.choice([4, 5, 6, 7]))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 6)))) for i in range(12)]
    rows += [(30, "Les.\nAll rights reserved."), (31, "All  rights reserved.\nLes"), (32, " Les. ")]
    rows += [(None, "a b a b a\nx"), (20, None), (21, ""), (3, "a  a a\ta a a"), (22, "q w e r t y u i o p\n\nq w e r t y u i o"), (22, "q w e r t y u i o p\n\nq w e r t y u i o"), (23, "é " * 3000 + "\n" + "é " * 2999)]
    frame = spark.createDataFrame([(*r, "d") for r in rows], "doc_id long, text string, d string")
    seeds = {(r.doc_id, r.text): r.t for r in frame.select("*", F.xxhash64("text").alias("t")).collect()}
    place = lambda d, t, n: (-(1 << 63) if d is None else d, seeds[d, t], n)
    long = {place(d, t, n): line.split() for d, t in set(rows) if t is not None for n, line in enumerate(t.split("\n")) if line.split()}
    want = []
    for d, t in rows:
        parts = t.split("\n") if t is not None else []
        gone = [n for n in range(len(parts)) if (me := place(d, t, n)) in long and any(o < me and (w == long[me] or edits and len(w) >= 5 and len(long[me]) >= 5 and one_edit(w, long[me])) for o, w in long.items())]
        want.append((d, "\n".join(x for n, x in enumerate(parts) if n not in gone) if gone else t, gone, "d"))
    got = line_dedup.dedup_lines(frame, edits=edits)
    assert sorted(((r.doc_id, r.text, r.dropped, r.d) for r in got.collect()), key=str) == sorted(want, key=str)
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_lines_whose_hashes_collide_are_told_apart(spark):
    """Polynomial hashes modulo 2**64 of a Thue-Morse sequence and of its complement are equal, whatever the base."""
    turn = [bin(k).count("1") % 2 for k in range(1024)]
    say = lambda bits, a="alpha", b="beta": " ".join((a, b)[x] for x in bits)
    other = [1 - x for x in turn]
    texts = [say(turn), say(other), "x " + say(turn), "y " + say(other), "z " + say(turn), "q " + say(other), say(turn)]
    lines = line_dedup.Lines(pa.array(texts[:2]))
    assert lines.hash(lines.first, lines.last)[0] == lines.hash(lines.first, lines.last)[1]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup_lines(frame).collect() if r.dropped} == {2, 3, 4, 5, 6}
    apart = [(0, "x " + say(turn)), (1, "y " + say(other)), (2, "z " + say(other))]
    frame = spark.createDataFrame(apart, "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup_lines(frame).collect() if r.dropped} == {2}


def test_hot_keys_of_lines_are_dealt(spark, monkeypatch):
    monkeypatch.setattr("mapframe.llm.common.LEAST_SPREAD", 5)
    rows = [(k, f"page {k} of the same old report\nthe same line everywhere it is") for k in range(200)] + [(500, "page of the same old report")]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _d int, dropped int")
    got = line_dedup.dedup_lines(frame)
    assert got.columns == ["doc_id", "text", "_d", "dropped", "n_lines"]
    assert {r.doc_id: list(r.dropped) for r in got.collect()} == {0: [], **{k: [0, 1] for k in range(1, 200)}, 500: [0]}
