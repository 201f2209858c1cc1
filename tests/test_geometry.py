import random

import pytest
from pyspark.sql import functions as F

from mapframe.functions import geo, style as styles, tags as T
from mapframe.operators import coast
from mapframe.operators.clip import clip
from mapframe.schema import Box, Style, Viewport

POINTS = "array<struct<x:double,y:double>>"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def clipped(spark, paths, w=10.0, h=10.0):
    frame = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in p]) for k, p in enumerate(paths)], f"k int, points {POINTS}")
    out = {}
    for r in clip(frame, w, h, ["k"]).orderBy("k", "sub").collect():
        out.setdefault(r.k, []).append([(p.x, p.y) for p in r.points])
    return out


def test_clip_cases(spark):
    got = clipped(spark, [[(1, 1), (5, 5)], [(-5, 5), (15, 5)], [(-5, 5), (5, 5), (5, 15), (7, 15), (7, 5)], [(-5, -5), (-1, 3)], [(0, -5), (0, 5)], [(-5, 5), (5, -5)], [(3, 3)], []])
    assert got[0] == [[(1, 1), (5, 5)]] and got[1] == [[(0, 5), (10, 5)]]
    assert got[2] == [[(0, 5), (5, 5), (5, 10)], [(7, 10), (7, 5)]]
    assert 3 not in got and 5 not in got and 6 not in got and 7 not in got
    assert got[4] == [[(0, 0), (0, 5)]]


def test_clipped_points_are_inside_and_cut_ends_on_the_edge(spark):
    rng = random.Random(1)
    paths = [[(rng.uniform(-10, 20), rng.uniform(-10, 20)) for _ in range(6)] for _ in range(300)]
    got = clipped(spark, paths)
    for k, parts in got.items():
        for part in parts:
            assert all(0 <= x <= 10 and 0 <= y <= 10 for x, y in part)
            for p in (part[0], part[-1]):
                assert p in (paths[k][0], paths[k][-1]) or p[0] in (0, 10) or p[1] in (0, 10)
    for k, path in enumerate(paths):  # as many parts as a dense sampling has runs inside
        flags = [0 < a[0] + (b[0] - a[0]) * t / 4000 < 10 and 0 < a[1] + (b[1] - a[1]) * t / 4000 < 10 for a, b in zip(path, path[1:]) for t in range(4000)]
        assert len(got.get(k, [])) == sum(b and not a for a, b in zip([False, *flags], flags))


def rings(spark, cases, w=10.0, h=10.0, correct=False):
    """The rings of each case, a list of paths."""
    rows = [(c, "f", k, 0, [(float(x), float(y)) for x, y in p]) for c, paths in enumerate(cases) for k, p in enumerate(paths)]
    parts = spark.createDataFrame(rows, f"c int, path string, way_id long, sub int, points {POINTS}")
    out = [[] for _ in cases]
    for r in coast.coast_rings(parts, w, h, ["c"], correct).orderBy("c", "ring").collect():
        out[r.c].append([(p.x, p.y) for p in r.points])
    return out


RING = [(2, 2), (4, 2), (3, 4), (2, 2)]
THREE = [[(1, 0), (1, 1), (2, 0)], [(3, 0), (3, 1), (4, 0)], [(5, 0), (5, 1), (6, 0)]]
#: Paths, the rings they make, and those with every corner if these differ.
CLOSED = [
    ([RING], [RING], None),
    ([[(2, 2), (4, 2)], [(4, 2), (3, 4), (2, 2)]], [RING], None),
    ([[(0, 5), (5, 5)]], [], None),  # ends inside
    ([[(0, 5), (10, 6)]], [[(0, 5), (10, 6), (10, 10), (0, 10), (0, 5)]], None),
    ([[(0, 5), (10, 5)]], [[(0, 5), (10, 5), (0, 5)]], [[(0, 5), (10, 5), (10, 10), (0, 10), (0, 5)]]),  # opposite edges, a shared coordinate: no corners
    ([[(2, 0), (5, 3), (7, 0)]], [[(2, 0), (5, 3), (7, 0), (2, 0)]], [[(2, 0), (5, 3), (7, 0), (10, 0), (10, 10), (0, 10), (0, 0), (2, 0)]]),  # around to the same edge: no corners
    ([[(5, 10), (5, 0)]], [[(5, 10), (5, 0), (5, 10)]], [[(5, 10), (5, 0), (10, 0), (10, 10), (5, 10)]]),  # likewise, top to bottom
]


@pytest.mark.parametrize("correct", [False, True])
def test_chain_and_close(spark, correct):
    *got, two, three = rings(spark, [*(c[0] for c in CLOSED), [[(0, 8), (10, 8)], [(10, 2), (0, 2)]], THREE], correct=correct)
    assert got == [full if correct and full else plain for _, plain, full in CLOSED]
    assert len(two) == 2 and all(r[0] == r[-1] for r in two)
    assert len(three) == 1 and three[0][0] == three[0][-1] and len(three[0]) == (14 if correct else 10)


def place(p, w, h):
    x, y = p
    return x if y == 0 else w + y if x == w else 2 * w + h - x if y == h else 2 * (w + h) - y


def by_hand(paths, w, h):
    """The same by trying all paths at every step."""
    work = {k: list(p) for k, p in enumerate(paths)}
    is_open = lambda k: work[k][0] != work[k][-1]
    for k in list(work):
        behind = -1
        while k in work and paths[k][0] != paths[k][-1]:
            able = [j for j in work if j != k and is_open(j) and work[j][0] == work[k][-1]]
            if not able:
                break
            behind = min(able, key=lambda j: (j <= behind, j))
            work[k] += work.pop(behind)[1:]
    for k in list(work):
        if is_open(k) and any(0 < x < w and 0 < y < h for x, y in (work[k][0], work[k][-1])):
            del work[k]
    edge = lambda p: 0 if p[1] == 0 else 1 if p[0] == w else 2 if p[1] == h else 3
    corner = [(w, 0), (w, h), (0, h), (0, 0)]
    for k in list(work):
        while k in work and is_open(k):
            a = work[k][-1]
            j = min((j for j in work if is_open(j)), key=lambda j: ((place(work[j][0], w, h) - place(a, w, h)) % (2 * (w + h)), j))
            b = work[j][0]
            if (a[0] != b[0] and a[1] != b[1]) or place(a, w, h) >= place(b, w, h):
                e = edge(a)
                while e != edge(b):
                    work[k].append(corner[e])
                    e = (e + 1) % 4
            if j == k:
                work[k].append(b)
                break
            tail = work.pop(j)
            work[k] += tail[work[k][-1] == b :]
    return list(work.values())


def test_rings_of_random_paths(spark):
    rng = random.Random(7)
    on_edge = lambda: rng.choice([(rng.randint(0, 6), 0), (6, rng.randint(0, 6)), (rng.randint(0, 6), 6), (0, rng.randint(0, 6))])
    inside = lambda: (rng.randint(1, 5), rng.randint(1, 5))
    cases = []
    for _ in range(150):
        paths = []
        for _ in range(rng.randint(1, 7)):
            stops = [rng.choice([on_edge, inside])() for _ in range(rng.randint(2, 4))]
            paths += [list(p) for p in zip(stops, stops[1:])] if rng.random() < 0.5 else [stops]
        rng.shuffle(paths)
        cases.append(paths)
    assert rings(spark, cases, 6.0, 6.0) == [by_hand(c, 6, 6) for c in cases]


def test_coast_table(spark):
    rows = [("t", "f", 1, 0, [(0.0, 5.0), (4.0, 5.0)]), ("t", "f", 2, 0, [(4.0, 5.0), (10.0, 6.0)]), ("u", "f", 1, 0, [(1.0, 1.0), (2.0, 2.0)])]
    parts = spark.createDataFrame(rows, f"tile string, path string, way_id long, sub int, points {POINTS}")
    got = [(r.tile, [(p.x, p.y) for p in r.points]) for r in coast.coast_rings(parts, 10, 10, ["tile"]).collect()]
    assert got == [("t", [(0, 5), (4, 5), (10, 6), (10, 10), (0, 10), (0, 5)])]
    assert coast.coast_rings(parts.limit(0), 10, 10, ["tile"]).count() == 0


def test_projection(spark):
    view = Viewport(Box(10, 20, 0, 0), 100, 40)
    assert view.box == Box(0, 0, 10, 20)
    p = geo.to_pixel(F.lit(0.1), F.lit(9.875), view)
    assert tuple(one(spark, p)[0]) == (1, 1)  # 0.5 goes away from zero
    pts = F.array(geo.point(F.lit(20.0), F.lit(0.0)))
    assert one(spark, geo.scale(geo.translate(pts, view), view))[0][0] == (100, 40)
    assert one(spark, geo.deg_to_nano(F.lit(-1.9999999999)), geo.deg_to_nano(F.lit(1.9999999999))) == (-1999999999, 1999999999)


def test_edges_and_corners(spark):
    e = lambda x, y: geo.edge_id(F.lit(x), F.lit(y), 10, 10)
    assert one(spark, e(10.0, 0.0), e(10.0, 5.0), e(3.0, 10.0), e(0.0, 5.0)) == (0, 1, 2, 3)
    assert one(spark, geo.perimeter_pos(F.lit(0.0), F.lit(4.0), 10, 10))[0] == 36
    with pytest.raises(Exception, match="not on the edge"):
        one(spark, geo.perimeter_pos(F.lit(3.0), F.lit(4.0), 10, 10))
    c = lambda a, b: [tuple(p) for p in one(spark, geo.corners_between(F.lit(a), F.lit(b), 10, 10))[0]]
    assert c(0, 0) == [] and c(3, 1) == [(0, 0), (10, 0)] and c(1, 0) == [(10, 10), (0, 10), (0, 0)]


def test_tags(spark):
    rows = [({"bridge": "no"}, "bridge", False, True), ({"natural": "coastline"}, "coast", False, True), ({"natural": "water", "bridge": "yes"}, "bridge", True, True), ({"landuse": "reservoid"}, None, True, True), ({"landuse": "reservoir"}, None, False, False), ({"waterway": "river"}, None, False, False), ({"Natural": "water"}, None, False, False), ({}, None, False, False), (None, None, False, False)]
    t = F.col("t")
    frame = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, t map<string,string>")
    got = [tuple(r) for r in frame.orderBy("k").select(T.kind(t), T.is_water(t), T.render_filter(t)).collect()]
    assert got == [r[1:] for r in rows]
    assert frame.where(T.is_water(t, reservoirs=True)).count() == 3


def test_colors(spark):
    texts = ["0xffaabbcc", "07f0000000", "12", "junk", "", " -1", "0XFFg", "99999999999999999999", "0", "08"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, s string").orderBy("k")
    got = [r[0] for r in frame.select(styles.parse_color(F.col("s"))).collect()]
    from mapframe.cli import c_integer

    assert got == [c_integer(t, 32) for t in texts] == [0xFFAABBCC, 7, 12, 0, 0, 0xFFFFFFFF, 0xFF, 0xFFFFFFFF, 0, 0]
    assert Style().hover_area == 0xFEC6D7E8 and one(spark, styles.mean_color(F.lit(0xFFAEC6E1), F.lit(0xFFDEE9F1)))[0] == 0xFEC6D7E8


def test_label_box(spark):
    view = Viewport(Box(0, 0, 1, 1), 100, 100)
    box = lambda cx, cy, w, h: tuple(one(spark, geo.label_box(*map(geo.num, (cx, cy, w, h)), view))[0])
    assert box(50, 50, 10.5, 9) == (44, 45, 12, 10) and box(0, 0, 10, 10) == (2, 2, 10, 10) and box(99, 99, 10, 10) == (88, 88, 10, 10)
    assert box(50, 50, 200, 10)[0] == -102  # the far side wins
