import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline as cp
from mapframe.llm import near_copies, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    """The component of each text, as the least position in it."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"e{rng.randrange(10**9)}"
    return words


def made(rng):
    texts = []
    for c in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([5, 9, 60, 200]))]
        texts += [" ".join(edited(rng, base, min(len(base) // 3, rng.randrange(0, 8)))) for _ in range(6)]
    common = [f"c{k}" for k in range(100)]
    return texts + [" ".join(common + [f"u{k}x{j}" for j in range(rng.choice([8, 15, 40]))]) for k in range(30)] + ["", None, " \n", "a b", "A  b", "a b c"]


@pytest.mark.parametrize("most", [near_copies.MOST, 300])
def test_near_copies_against_brute_force(spark, most):
    texts = made(random.Random(3))
    want = {i for i, c in enumerate(brute(texts)) if i == c}
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    kept = near_copies.one_of_each(frame, most=most)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == want and 20 < len(want) < len(texts) - 20
    assert near_copies.one_of_each(frame.limit(0)).count() == 0


def test_stage_finds_copies_that_differ_in_many_bits(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(150)] for _ in range(40)]
    texts = [" ".join(w) for b in base for w in (b, edited(rng, b, 3))]
    fps = simhash.fingerprints_of(pa.array(texts))
    assert np.count_nonzero(np.bitwise_count(fps[::2] ^ fps[1::2]) > 4) > 20  # out of reach of the radius of operator 9
    assert all(5 * len(shingles(a) & shingles(b)) >= 4 * len(shingles(a) | shingles(b)) for a, b in zip(texts[::2], texts[1::2]))
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.keep_one_of_near_copies(spark, frame, "").collect()} == set(range(0, 80, 2))


def test_spanning_forest_of_one_cell():
    rng = random.Random(5)
    texts = [t for t in made(rng) if t and t.split()]
    hashes, bounds = near_copies.shingle_sets(pa.array(texts))
    label = list(range(len(texts)))
    for i, j in near_copies.spanning([hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]):
        assert label[i] != label[j]
        old, new = max(label[i], label[j]), min(label[i], label[j])
        label = [new if x == old else x for x in label]
    assert label == brute(texts)


def test_fingerprint_by_its_definition():
    texts = ["a b c d e f g a b c d e f g h", "", None, "A  b", " ".join(f"w{k % 700}" for k in range(2000))]
    hashes, bounds = near_copies.shingle_sets(pa.array(texts))
    for text, own in zip(texts, near_copies.signatures(hashes, bounds)):
        h = [xxhash.xxh64_intdigest(" ".join(s).encode(), simhash.SEED) for s in shingles(text)]
        assert int(own[0]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_propose_the_pairs_of_the_stage(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(5000)}" for _ in range(150)] for _ in range(20)]
    texts = [" ".join(w) for b in base for w in (b, edited(rng, b, 2))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_copies.one_of_each(frame, radius=0).count() == 40  # no two fingerprints are equal
    assert {r.doc_id for r in near_copies.one_of_each(frame).collect()} == set(range(0, 40, 2))


@pytest.mark.parametrize("size, other, shared", [(5, 4, 4), (9, 9, 8), (90, 90, 80), (100, 80, 80)])
def test_pairs_at_the_least_similarity_share_a_key_and_lie_within_the_radius(size, other, shared):
    rng, many = np.random.default_rng(size), 5000
    sets = [x for _ in range(many) for h in [rng.integers(0, 1 << 64, size + other - shared, np.uint64)] for x in (h[:size], h[size - shared :][:other])]
    s = near_copies.signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    apart = s[::2] ^ s[1::2]
    within = np.bitwise_count(apart).sum(axis=1) <= near_copies.RADIUS
    for n in (1000, 200_000, 12_000_000):
        proposed = within & np.any([((apart & m) == 0).all(axis=1) for m in near_copies.masks(n)], axis=0)
        assert proposed.sum() >= many * (0.995 if (size, n) == (5, 12_000_000) else 0.999)


@pytest.mark.parametrize("group", [simhash.GROUP, 20])
def test_links_within_the_radius(spark, group, monkeypatch):
    rng = np.random.default_rng(4)
    s = np.repeat(rng.integers(0, 1 << 64, (30, near_copies.WIDE), np.uint64), 20, axis=0)
    for row in s:
        for bit in rng.choice(64 * near_copies.WIDE, 12, replace=False):
            row[bit // 64] ^= np.uint64(1 << (bit % 64))
    size = rng.integers(90, 101, len(s))
    size[::20] = 20  # like none of the others
    rows = [(k, int(n), *row) for k, (n, row) in enumerate(zip(size, s.view(np.int64).tolist()))]
    frame = spark.createDataFrame(rows, "fp long, n long, s0 long, s1 long, s2 long")
    label = np.arange(len(s))
    for r in near_copies.within_radius(frame, 200_000, group=group).collect():
        label[label == max(label[r.u], label[r.v])] = min(label[r.u], label[r.v])
    want = [k if k % 20 == 0 else k // 20 * 20 + 1 for k in range(len(s))]
    assert label.tolist() == want
    cell = np.zeros(len(s), np.int64)
    for large in (1, 4096):
        monkeypatch.setattr(near_copies, "LARGE", large)
        label = np.arange(len(s))
        for u, v in zip(*near_copies._forest(cell, np.arange(len(s)), size, s.T.copy(), near_copies.RADIUS)):
            label[label == max(label[u], label[v])] = min(label[u], label[v])
        assert label.tolist() == want
