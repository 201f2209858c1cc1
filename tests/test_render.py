import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapframe import cli
from mapframe.operators.cache import backdrop_key
from mapframe.operators.display import differences
from mapframe.operators.raster import atlas, changed, coverage, draw, load_images, png, read_png, stroke, trimmed
from mapframe.plans.render import render_city, write_city
from mapframe.schema import Box, Style, Viewport
from mapframe.sources.config import load_config
from tests import pbf_writer as w

UNIT = 10**7  # 100 nanodegrees


@pytest.fixture
def city(tmp_path):
    config = {"areaBox": [10, 10, 0, 0], "areas": [{"polygon": "1 1,1 5,5 5", "label": "One\nTown", "center": [3, 3], "type": 1}, {"polygon": "6 6,6 9,9 9", "label": "Park", "center": [8, 8], "type": 2}], "landmarks": [{"display": True, "lat": 5, "lon": 5, "label": "Tower"}, {"display": False, "lat": 1, "lon": 1, "label": "Hidden"}]}
    (tmp_path / "city.json").write_text(json.dumps(config))
    nodes = [(1, 5 * UNIT, -1 * UNIT), (2, 5 * UNIT, 5 * UNIT), (3, 3 * UNIT, 15 * UNIT), (4, 2 * UNIT, 2 * UNIT), (5, 2 * UNIT, 3 * UNIT), (6, 3 * UNIT, 3 * UNIT)]
    ways = [(1, [("natural", "coastline")], [1, 2, 3]), (2, [("natural", "water")], [4, 5, 6]), (3, [("bridge", "yes")], [4, 6]), (4, [("highway", "path")], [4, 5])]
    head = w.header(tuple(int(x * 1e9) for x in (-20, 20, 20, -20)))
    w.write(tmp_path / "a.osm.pbf", w.frame("OSMHeader", head), w.frame("OSMData", w.block(nodes[:1])))
    w.write(tmp_path / "b.osm.pbf", w.frame("OSMHeader", head), w.frame("OSMData", w.block(nodes, ways)))
    return tmp_path


def options(city, *more):
    return cli.parse_options(["--map-directory", str(city), "--prefix", str(city / "out"), "--cache-dir", str(city / "cache"), *more, str(city / "city.json")])[0]


def test_city(spark, city):
    made = render_city(spark, options(city))
    atlas = made["atlas"].cache()
    assert {(r.mode, r.area_idx) for r in atlas.select("mode", "area_idx").distinct().collect()} == {("BASE", -1), ("HOVER", 0), ("HOVER", 1), ("ACTIVE", 0), ("ACTIVE", 1)}
    base = atlas.where("mode = 'BASE'").orderBy("z").collect()
    assert [r.cmd for r in base] == ["rect", "fill_masked", "fill_masked", "mask_stroke", "mask_stroke", "fill_multi", "fill", "stroke", "text", "icon", "text", "rect"]
    coast = next(r for r in base if r.cmd == "fill_multi")
    assert sum([[p.x, p.y] for p in coast.points], []) == pytest.approx([0, 198, 198, 198, 396, 237.6, 396, 396, 0, 396, 0, 198])
    assert atlas.where("mode = 'HOVER' and area_idx = 0").select("cmd").orderBy("z").collect()[0].cmd == "fill_masked"
    assert {r.cmd for r in atlas.where("mode = 'HOVER' and area_idx = 0").collect()} == {"fill_masked", "rect_round", "text"}
    assert atlas.where("mode = 'ACTIVE' and area_idx = 1").first().color == Style().active_area
    calls = made["callouts"]
    assert {r.file for r in calls.select("file").distinct().collect()} == {f"{city}/out-00-callout.png", f"{city}/out-01-callout.png"}
    assert calls.where("cmd = 'rect' and color = %d" % Style().land).first().points[1].x == 290


def test_cache_and_output(spark, city):
    write_city(spark, options(city))
    assert len(list((city / "cache").iterdir())) == 2
    assert spark.read.parquet(f"{city}/out-callouts.parquet").select("area_idx").distinct().count() == 2
    sheet = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in load_images(spark, f"{city}/*.png").collect()}
    assert sheet["out-00-callout.png"] == sheet["out-01-callout.png"] == (290, 290) and min(sheet["out.png"]) >= 396
    again = render_city(spark, options(city))["atlas"]
    assert len(list((city / "cache").iterdir())) == 2
    assert again.where("cmd = 'fill_multi' and mode = 'BASE'").count() == 1  # the backdrop was kept
    os.utime(city / "b.osm.pbf", (1, 1))
    render_city(spark, options(city))
    assert len(list((city / "cache").iterdir())) == 4  # another extract of the same name
    (city / "b.osm.pbf").unlink()
    assert render_city(spark, options(city, "--no-cache"))["atlas"].where("cmd = 'fill_multi'").count() == 0  # areas are drawn all the same


def test_dummy_run_keeps_nothing(spark, city):
    made = render_city(spark, options(city, "--dummy-run"))
    assert made["atlas"].where("cmd in ('fill', 'stroke', 'fill_multi')").count() == 0 and not (city / "cache").exists()


def test_water_behind(spark, city):
    one = options(city)
    from dataclasses import replace

    made = render_city(spark, replace(one, cache_dir=None, style=Style(water_in_front=False)))["atlas"].where("mode = 'BASE'").orderBy("z").collect()
    assert [r.cmd for r in made][:4] == ["rect", "fill_multi", "fill", "stroke"]


def test_differences_of_equal_pictures(spark, city):
    from mapframe.operators.display import display_list
    from mapframe.sources.config import load_config

    c = load_config(spark, str(city / "city.json"))
    view = Viewport(c.box)
    full = display_list(None, c.areas, c.landmarks, view, Style(), ("BASE", "ACTIVE"))
    assert differences(full.where("mode = 'BASE'").unionByName(full.where("mode = 'BASE'").withColumn("mode", F.lit("HOVER")))).count() == 0


@pytest.mark.parametrize("text, message", [("[1]", "root level|parsed"), ("{bad", "parsed"), ("{}", "missing an areaBox"), ('{"areaBox":[1,2,3]}', "exactly 4")])
def test_bad_config(spark, tmp_path, text, message):
    (tmp_path / "c.json").write_text(text)
    with pytest.raises(ValueError, match=message):
        load_config(spark, str(tmp_path / "c.json"))


def test_bad_center_and_vertex(spark, tmp_path):
    area = {"polygon": "1 1,x,2 2", "label": "L", "center": [1, 2], "type": 0}
    (tmp_path / "c.json").write_text(json.dumps({"areaBox": [0, 0, 1, 1], "areas": [area]}))
    with pytest.raises(Exception, match="vertex"):
        load_config(spark, str(tmp_path / "c.json")).areas.collect()
    got = load_config(spark, str(tmp_path / "c.json"), strict=False).areas.first()
    assert [(p.x, p.y) for p in got.points] == [(1, 1), (1, 1), (2, 2)]
    (tmp_path / "d.json").write_text(json.dumps({"areaBox": [0, 0, 1, 1], "areas": [area | {"polygon": "1 1", "center": [1]}]}))
    with pytest.raises(Exception, match="not 2 elements"):
        load_config(spark, str(tmp_path / "d.json")).areas.collect()


def test_options(tmp_path):
    (tmp_path / "o.cfg").write_text('--landmark-font="Arial 8"\n--active-area-font-bgcolor=07f0000000\n--land-color=0xfff8f3ed\n')
    run = cli.parse_options(["--options-file", str(tmp_path / "o.cfg"), "--size", "0x10", "a.json", "b.json"])
    assert [r.prefix for r in run] == ["output-a", "output-b"] and run[0].size == 16
    assert run[0].style.active_label_background == 7 and run[0].style.land == 0xFFF8F3ED
    for argv in ([], ["--none", "x"]):
        with pytest.raises(SystemExit) as stop:
            cli.parse_options(argv)
        assert stop.value.code == 2


def test_cache_key_depends_on_its_parts():
    view, style = Viewport(Box(0, 0, 1, 1)), Style()
    keys = {backdrop_key(view, style), backdrop_key(view.callout(), style), backdrop_key(view, Style(water=1)), backdrop_key(view, Style(water_in_front=False)), backdrop_key(view, style, ["a"]), backdrop_key(view, style, ["b"]), backdrop_key(view, style, ["a"], "r")}
    assert len(keys) == 7


def test_coverage_and_strokes():
    square = [(1, 1), (3, 1), (3, 3), (1, 3)]
    got = coverage([square], 5, 5)
    assert got.sum() == pytest.approx(4) and got[1:3, 1:3].min() == 1
    assert coverage([square, square[::-1]], 5, 5).sum() == 0  # windings cancel
    assert coverage([[(0.5, 0), (1.5, 0), (1.5, 1), (0.5, 1)]], 3, 2)[0].tolist() == pytest.approx([0.5, 0.5, 0])
    assert coverage(stroke([(0, 2), (5, 2)], 2), 5, 5).sum() == pytest.approx(10)
    assert coverage([], 2, 2).sum() == 0 and coverage([[(0, 0), (1, 1)]], 2, 2).sum() == 0


def test_drawing_erases_and_masks():
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    c = lambda z, cmd, color, points, **more: {"z": z << 32, "cmd": cmd, "color": color, "width": None, "op": "over", "text": None, "points": points} | more
    square = p((0, 0), (20, 0), (20, 20), (0, 20), (0, 0))
    rows = [c(0, "rect", 0xFFFFFFFF, p((0, 0), (20, 20))), c(2, "fill_masked", 0xFF00FF00, square), c(3, "mask_stroke", None, square, width=3.0), c(4, "fill", 0xFF0000FF, p((5, 5), (15, 5), (15, 15), (5, 15))), c(4, "stroke", 0xFFFFFFFF, p((5, 10), (15, 10)), width=2.0, op="dest_out")]
    got = draw(rows, 20, 20)
    assert got[0, 0].tolist() == [255, 255, 255, 255]  # the outline is left out of the mask
    assert got[3, 3].tolist() == [0, 255, 0, 255] and got[6, 6].tolist() == [0, 0, 255, 255]
    assert got[10, 10].tolist() == [0, 255, 0, 255]  # the bridge shows what is under the water


def test_png_round_trip_and_atlas():
    import numpy as np

    image = np.random.default_rng(1).integers(0, 256, (7, 5, 4), dtype=np.uint8)
    assert (read_png(png(image)) == image).all()
    with pytest.raises(ValueError):
        read_png(b"no")
    other = image.copy()
    other[2, 3] ^= 255
    only = changed(other, image)
    assert (only[2, 3] == other[2, 3]).all() and np.count_nonzero(only.any(axis=2)) == 1
    assert trimmed(np.zeros((4, 4, 4), np.uint8)).shape == (1, 1, 4)
    sheet = atlas([image, image[:3], image[:2, :2]])
    assert sum((sheet[y : y + 7, x : x + 5] == image).all() for y in range(sheet.shape[0] - 6) for x in range(sheet.shape[1] - 4)) == 1


def test_icons_and_rounded_corners():
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    c = lambda z, cmd, color, points, **more: {"z": z << 32, "cmd": cmd, "color": color, "width": None, "op": "over", "text": None, "points": points} | more
    image = np.full((4, 5, 4), 255, np.uint8)
    got = draw([c(5, "icon", None, p((10.4, 1)))], 20, 20, image)[..., 3]
    assert got[0:3, 7:12].min() == 255 and got.astype(bool).sum() == 15  # the upper row is outside
    assert draw([c(5, "icon", None, p((10, 10)))], 20, 20)[..., 3].any()
    box = draw([c(5, "rect_round", 0xFF000000, p((2, 2), (18, 18)), width=4.0)], 20, 20)[..., 3]
    assert box[2, 2] < 40 and box[2, 10] == 255 and box[10, 2] == 255
