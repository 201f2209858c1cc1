import gzip
import math
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mapframe.llm import top_k, warc
from mapframe.llm.common import fresh_path
from tests.oracle import same


def test_op3_matches_sql(spark):
    assert same(spark, top_k.op3_top_k, top_k.ORACLE_SQL) == 50


def test_op6_matches_sql(spark):
    assert same(spark, warc.op6_warc, warc.ORACLE_SQL) == 50


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 1000), st.integers(1, 400), st.integers(1, 5))
def test_branch_and_bound_is_exact(seed, n, k):
    rng = np.random.default_rng(seed)
    points, queries = (rng.integers(-3, 4, (m, 3)).astype(float) for m in (n, 7))
    ids = rng.permutation(n)
    best = top_k.Best(len(queries), k, np.full(len(queries), -np.inf))
    top_k.search(top_k.BallTree(points, leaf=8), ids, queries, np.full(len(queries), -1), best)
    best.cut()
    for q in range(len(queries)):
        want = sorted(zip((points @ queries[q]).tolist(), ids.tolist()), key=lambda x: (-x[0], x[1]))[:k]
        assert list(zip(best.score[best.query == q].tolist(), best.id[best.query == q].tolist())) == want


def test_bounds_save_work():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 1, (500, 8)) for c in (np.eye(8) * 100)])
    best = top_k.Best(1, 5, np.array([-np.inf]))
    assert top_k.search(top_k.BallTree(points), np.arange(len(points)), points[:1], np.array([0]), best) < len(points) / 2


def test_top_k_of_odd_rows(spark):
    nan = float("nan")
    rows = [(i, [0.1 * (i % 3), -0.3, 1e9 if i % 7 == 0 else 0.5]) for i in range(60)]
    rows += [(50, [0.1, 0.2, 0.3]), (None, [1.0, 2.0, 3.0]), (100, None), (150, [nan, 1.0, 2.0]), (200, [None, 1.0, 1.0]), (250, []), (300, []), (350, [1e30, 1.0, 1.0]), (400, [1.0, 2.0]), (450, [1e307, 1.0, 1.0])]
    rows += [(1000 + i, [3e20 * (i % 5), -2e20, 1.0 + i % 2]) for i in range(30)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    want = []
    for i, v in usable:
        if i % 50 == 0:
            scored = sorted(((max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, x)))), j) for j, x in usable if j != i and len(x) == len(v)), key=lambda s: (-s[0], s[1]))
            want += [(i, r + 1, j, s) for r, (s, j) in enumerate(scored[:5])]
    for settings_ in ({}, {"query_block": 2, "shard": 7}):
        got = top_k.top_k(frame, F.col("vec_id") % 50 == 0, **settings_).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    long = spark.createDataFrame([(i, [float((i * 7 + k) % 11) for k in range(30_000)]) for i in range(6)], "vec_id long, embedding array<double>")
    assert top_k.top_k(long, F.col("vec_id") == 0, k=2).select("rank").collect() == [(1,), (2,)]
    assert top_k.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


ROWS = [(1, "u", "a", 0), (2, None, "a", 0), (3, "x y\r\nz", "", 0), (4, "u", None, 0), (5, "u", "b", 0), (None, "u", "b", 0), (None, None, "c", 0), (None, None, "c", 0), (7, "q", "a", 0), (7, "q", "a", 0), (8, "r", "é\r\n\r\nWARC/1.1\r\n" * 3000, 0)]


def test_warc_round_trip(spark):
    frame = spark.createDataFrame(ROWS, "page_id long, url string, html string, record_type int")
    largest = {}
    for p, _, h, _ in ROWS:
        largest[h or ""] = max((x for x in (largest.get(h or ""), p) if x is not None), default=None)
    want = sorted(((p, len((h or "").encode()), "response" if p == largest[h or ""] else "revisit", None if p == largest[h or ""] else largest[h or ""]) for p, _, h, _ in ROWS), key=str)
    for most in (200_000, 1):
        out = fresh_path(spark, "w")
        parts = warc.write_archives(warc.planned(frame, most_broadcast=most), out)
        warc.normalise_archives(spark, out, parts, keep=True)
        got = warc.read_archives(spark, out, parts).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == want
    least = warc.planned(frame, least_bytes=1).where("html = ''")
    assert {r.record_type for r in least.collect()} == {"response"}
    out = fresh_path(spark, "w")
    assert warc.write_archives(warc.planned(frame.limit(0)), out) == [] and warc.read_archives(spark, out, []).count() == 0


def test_normaliser(tmp_path):
    records = [warc.record(k, f"http://x/{k}", b"p" * k, None, "2020-01-01T00:00:00Z") for k in range(50)]
    (tmp_path / "mono.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "two.gz").write_bytes(gzip.compress(b"".join(records[:20])) + gzip.compress(b"".join(records[20:])))
    for name in ("mono.gz", "two.gz"):
        assert warc.normalise(str(tmp_path / name), str(tmp_path / "out.warc.gz")) == 50
        index = np.fromfile(tmp_path / "out.warc.gz.idx", "<u8").reshape(-1, 2)
        data = (tmp_path / "out.warc.gz").read_bytes()
        assert [gzip.decompress(data[a : a + n]) for a, n in index.tolist()] == records
        assert gzip.decompress(data) == b"".join(records)
    by_page = defaultdict(int)
    for one in records:
        by_page[warc.parsed(one)[0]] += 1
    assert by_page == {k: 1 for k in range(50)}
