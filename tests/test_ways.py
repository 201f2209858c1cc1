import random

import pytest
from pyspark.sql import functions as F

from mapframe.functions.tags import render_filter
from mapframe.operators import ways as W
from mapframe.schema import NODES, RELATIONS, WAYS, Box

BOX = Box(0, 0, 10, 10)
nano = lambda x: int(x * 1e9)


def tables(spark, nodes, ways, relations=()):
    n = spark.createDataFrame([(p, o, i, nano(lat), nano(lon)) for o, (p, i, lat, lon) in enumerate(nodes)], NODES)
    w = spark.createDataFrame([(p, o, i, t, r) for o, (p, i, t, r) in enumerate(ways)], WAYS)
    r = spark.createDataFrame([(p, o, i, t, [(k, *m) for k, m in enumerate(ms)]) for o, (p, i, t, ms) in enumerate(relations)], RELATIONS)
    return n, w, r


def plain(nodes, ways, relations, box, where):
    """The same in plain Python, file by file."""
    out = {}
    for path in {x[0] for x in ways}:
        at = {i: (lon, lat) for p, i, lat, lon in nodes if p == path}
        inside = {i for i, (x, y) in at.items() if box.lon_min <= x <= box.lon_max and box.lat_min <= y <= box.lat_max}
        inside |= {i for p, i, lat, lon in nodes if p == path and box.lat_min <= lat <= box.lat_max and box.lon_min <= lon <= box.lon_max}
        mine = [x for x in ways if x[0] == path and where(x[2])]
        hit = {i for _, i, _, refs in mine if inside & set(refs)}
        for _, i, t, refs in mine:
            if i in hit and refs:
                out[path, i] = (dict(t), [at[r] for r in refs])
        for p, _, t, members in relations:
            for kind, ref in members:
                if p == path and kind == "WAY" and (path, ref) in out:
                    out[path, ref][0].update(t)
    return out


def run(spark, nodes, ways, relations, where=None, strict=True, held=None):
    found = W.ways_in_rect(*tables(spark, nodes, ways, relations), BOX, where, strict, held=held)
    return {(r.path, r.way_id): (r.tags, [(p.x, p.y) for p in r.points]) for r in found.collect()}


def test_random_data(spark, monkeypatch):
    rng = random.Random(3)
    nodes = [(p, i, rng.randint(-8, 18), rng.randint(-8, 18)) for p in "ab" for i in range(60)]
    tags = lambda: {k: v for k, v in (("bridge", "no"), ("natural", rng.choice(["water", "wood", "coastline"])), ("name", str(rng.randint(0, 5)))) if rng.random() < 0.5}
    ways = [(p, i, tags(), [rng.randrange(60) for _ in range(rng.randint(0, 5))]) for p in "ab" for i in range(80)]
    relations = [(p, i, tags(), [(rng.choice(["NODE", "WAY", "RELATION"]), rng.randrange(80)) for _ in range(4)]) for p in "ab" for i in range(30)]
    keep = lambda t: "bridge" in t or t.get("natural") in ("water", "coastline")
    got, want = run(spark, nodes, ways, relations, render_filter), plain(nodes, ways, relations, BOX, keep)
    for most in (W.MOST_REFS, 3):
        held = []
        monkeypatch.setattr(W, "MOST_REFS", most)
        assert run(spark, nodes, ways, relations, render_filter, held=held) == got and len(held) == 1
        held[0].unpersist()
    assert got.keys() == want.keys() and len(got) > 5
    for k, (t, points) in want.items():
        assert got[k][0] == t and sum(got[k][1], ()) == pytest.approx(sum(points, ()))


def test_edges_count_and_crossings_do_not(spark):
    nodes = [("f", 1, 0, 5), ("f", 2, 10, 5), ("f", 3, 5, 0), ("f", 4, 5, 10), ("f", 5, -1, 5), ("f", 6, 11, 5)]
    ways = [("f", k, {}, [k, 5]) for k in (1, 2, 3, 4)] + [("f", 9, {}, [5, 6]), ("f", 8, {}, [])]
    assert {k for _, k in run(spark, nodes, ways, [])} == {1, 2, 3, 4}


def test_filter_comes_before_relations(spark):
    nodes, ways = [("f", 1, 5, 5)], [("f", 1, {"natural": "wood"}, [1]), ("f", 2, {"natural": "water"}, [1])]
    relations = [("f", 1, {"natural": "coastline"}, [("WAY", 1), ("WAY", 2)]), ("g", 2, {"other": "file"}, [("WAY", 2)])]
    assert {k: t for (_, k), (t, _) in run(spark, nodes, ways, relations, render_filter).items()} == {2: {"natural": "coastline"}}


def test_last_of_equal_ids_wins(spark):
    nodes = [("f", 1, 50, 50), ("f", 1, 5, 5)]
    ways = [("f", 1, {"v": "1", "ok": ""}, [1]), ("f", 1, {"v": "2", "ok": ""}, [1, 1]), ("f", 1, {"v": "3"}, [1])]
    got = run(spark, nodes, ways, [], lambda t: F.map_contains_key(t, "ok"))
    assert got["f", 1][0]["v"] == "2" and sum(got["f", 1][1], ()) == pytest.approx((5, 5, 5, 5))


def test_missing_node(spark):
    nodes, ways = [("f", 1, 5, 5)], [("f", 1, {}, [1, 2, 1])]
    with pytest.raises(Exception, match="not in its file"):
        run(spark, nodes, ways, [])
    assert len(run(spark, nodes, ways, [], strict=False)["f", 1][1]) == 2


def test_empty_tables(spark):
    assert run(spark, [], [], []) == {}


def test_box_reaches_the_scan_of_the_nodes(spark, tmp_path):
    n, w, r = tables(spark, [("f", 1, 5, 5)], [("f", 1, {}, [1])])
    n.write.parquet(str(tmp_path / "n"))
    plan = W.ways_touching(W.way_refs(w), spark.read.parquet(str(tmp_path / "n")), BOX)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(lat_nano)" in plan and "GreaterThanOrEqual(lat_nano,0)" in plan
