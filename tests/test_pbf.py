import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from mapframe.schema import Box
from mapframe.sources import wire
from mapframe.sources.files import covering_files
from mapframe.sources.pbf import read_pbf
from tests import pbf_writer as w

BIG = (1 << 31) + 5


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@given(st.lists(st.integers(-(1 << 62), 1 << 62)))
def test_deltas_round_trip(numbers):
    coded = b"".join(w.varint(w.zig(d)) for d in w.deltas(numbers)) if all(abs(d) < 1 << 63 for d in w.deltas(numbers)) else None
    if coded is not None:
        assert wire.running([memoryview(coded)] if coded else []).tolist() == numbers


@given(st.lists(st.integers(0, (1 << 64) - 1)))
def test_varints(numbers):
    assert wire.unsigned([b"".join(map(w.varint, numbers))]).tolist() == numbers
    assert wire.unsigned(numbers).tolist() == numbers


def test_cut_off_numbers():
    with pytest.raises(ValueError):
        wire.varint(b"\x80", 0)
    with pytest.raises(ValueError):
        wire.unsigned([b"\x80"])
    with pytest.raises(ValueError):
        wire.fields(w.varint(1 << 3 | 2) + w.varint(9) + b"x")


_messages = st.lists(st.lists(st.tuples(st.sampled_from([1, 2, 8]), st.lists(st.integers(-(1 << 40), 1 << 40), max_size=4), st.booleans()), max_size=5), max_size=6)


@given(_messages)
def test_many_messages_at_once(messages):
    """Packed and plain numbers, empty fields and empty messages are those that each message holds by itself."""
    coded = [b"".join(w.blob(n, b"".join(w.varint(w.zig(x)) for x in xs)) if packed else b"".join(w.num(n, w.zig(x)) for x in xs) for n, xs, packed in m) for m in messages]
    found, alone = wire.scan(coded), [wire.fields(c) for c in coded]
    assert [int(n) for n in wire.single(found, 1)] == [next((wire.int64(x) for x in reversed(a.get(1, [])) if isinstance(x, int)), 0) for a in alone]
    for number in (1, 2, 8):
        values, many = wire.repeated(found, number)
        each = [wire.unsigned(a.get(number, [])) for a in alone]
        assert many.tolist() == [len(x) for x in each] and values.tolist() == [int(v) for x in each for v in x]
        assert wire.running_each(values, many).tolist() == [int(v) for a in alone for v in wire.running(a.get(number, []))]


@pytest.mark.parametrize("broken", [b"\x80", w.varint(1 << 3 | 2) + w.varint(9) + b"x", w.varint(1 << 3 | 3), w.varint(1 << 3 | 1) + b"1234567", w.varint(8) + b"\x80" * 11])
def test_broken_messages(broken):
    with pytest.raises(ValueError):
        wire.scan([b"", w.num(1, 5), broken])
    with pytest.raises(ValueError, match="cut off"):
        wire.repeated(wire.scan([w.blob(2, b"\x01"), w.blob(2, b"\x01\x80"), w.blob(2, b"\x01")]), 2)


@pytest.fixture
def city(tmp_path):
    nodes = [(10, 100, -200), (7, -5, 30), (BIG, 1, 1)]
    data = w.block(nodes, [(BIG, [("bridge", "no"), ("name", "Brücke")], [10, 7, BIG, 10]), (3, [], [])], [(9, [("natural", "water")], [(0, 10), (1, BIG), (2, 4)])], groups=2)
    more = w.block([(11, 2, 2)], single=[(12, 5, -6)], granularity=1000, lat_offset=7, lon_offset=-9)
    return w.write(tmp_path / "a.osm.pbf", w.frame("OSMHeader", w.header((-5, 6, 7, -8))), w.frame("OSMData", data), w.frame("Other", b"skip"), w.frame("OSMData", more, raw=True, sized=False))


def test_entities(spark, city):
    assert rows(read_pbf(spark, city, "nodes").select("node_id", "lat_nano", "lon_nano")) == rows(spark.createDataFrame([(10, 10000, -20000), (7, -500, 3000), (BIG, 100, 100), (11, 2007, 1991), (12, 5007, -6009)], "a long, b long, c long"))
    ways = {r.way_id: r for r in read_pbf(spark, city, "ways").collect()}
    assert ways[BIG].tags == {"bridge": "no", "name": "Brücke"} and ways[BIG].refs == [10, 7, BIG, 10] and ways[3].refs == []
    relation = read_pbf(spark, city, "relations").first()
    assert [tuple(m) for m in relation.members] == [(0, "NODE", 10), (1, "WAY", BIG), (2, "RELATION", 4)]
    head = read_pbf(spark, city, "header").first()
    assert (head.left_nano, head.right_nano, head.top_nano, head.bottom_nano, head.program) == (-5, 6, 7, -8, "w")
    assert [(r.idx, r.type, r.codec) for r in read_pbf(spark, city, "blobs").orderBy("idx").collect()] == [(0, "OSMHeader", "zlib"), (1, "OSMData", "zlib"), (2, "Other", "zlib"), (3, "OSMData", "raw")]


def test_partitions_and_fixed_granularity(spark, city):
    split = read_pbf(spark, city, "nodes", partition_bytes=1)
    assert split.count() == 5 and split.rdd.getNumPartitions() == 2
    assert read_pbf(spark, city, "nodes", fixed_granularity=True).where("node_id = 11").first().lat_nano == 207


@pytest.mark.parametrize("pushdown", ["true", "false"])
def test_nodes_of_a_box(spark, city, pushdown):
    """The option leaves nodes out; a filter on one scan leaves the other scans of the same table whole."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushdown)
    try:
        inside = "lat_nano >= 0 and lat_nano <= 10000 and lon_nano >= 0"
        nodes = read_pbf(spark, city, "nodes")
        cut = nodes.where(inside)
        assert {r.node_id for r in cut.collect()} == {r.node_id for r in read_pbf(spark, city, "nodes", box="0,0,10000,90000").collect()} == {BIG, 11}
        assert nodes.count() == 5 and nodes.union(cut).count() == 7
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="four numbers"):
        read_pbf(spark, city, "ways", box="0,0,1,1").collect()


def test_broken_files(spark, tmp_path):
    whole = w.frame("OSMHeader", w.header())
    for name, data in {"length": whole + b"\0\0", "header": b"\0\0\xff\0", "blob": whole[:-1]}.items():
        (tmp_path / f"{name}.osm.pbf").write_bytes(data)
        with pytest.raises(Exception, match="ends within|beyond the end"):
            read_pbf(spark, str(tmp_path / f"{name}.osm.pbf"), "nodes").collect()
    lzma = w.blob(4, b"x")
    head = w.blob(1, b"OSMData") + w.num(3, len(lzma))
    path = w.write(tmp_path / "lzma.osm.pbf", len(head).to_bytes(4, "big") + head + lzma)
    with pytest.raises(Exception, match="unsupported compression"):
        read_pbf(spark, path, "nodes").collect()
    wrong = w.blob(1, b"abc") + w.num(2, 4)
    head = w.blob(1, b"OSMData") + w.num(3, len(wrong))
    path = w.write(tmp_path / "size.osm.pbf", len(head).to_bytes(4, "big") + head + wrong)
    with pytest.raises(Exception, match="holds 3 bytes"):
        read_pbf(spark, path, "nodes").collect()


def test_repeated_tag_key(spark, tmp_path):
    path = w.write(tmp_path / "t.osm.pbf", w.frame("OSMData", w.block(ways=[(1, [("a", "1"), ("a", "2")], [])])))
    with pytest.raises(Exception, match="repeats within a way"):
        read_pbf(spark, path, "ways").collect()
    assert read_pbf(spark, path, "ways", strict=False).first().tags == {"a": "2"}


def test_tags_that_do_not_pair(spark, tmp_path):
    """A key without a value is an error, or else left out; of a key that repeats in a relation the last value counts."""
    strings = w.blob(1, b"".join(w.blob(1, x) for x in (b"", b"a", b"1", b"2", b"a")))
    way = w.num(1, 7) + w.packed(2, [1, 2]) + w.packed(3, [3])
    relation = w.num(1, 8) + w.packed(2, [1, 2, 4]) + w.packed(3, [2, 3, 3]) + w.packed(9, [5, 5], True) + w.packed(10, [1])
    path = w.write(tmp_path / "p.osm.pbf", w.frame("OSMData", strings + w.blob(2, w.blob(3, way) + w.blob(3, w.num(1, 9)) + w.blob(4, relation))))
    with pytest.raises(Exception, match="keys without values"):
        read_pbf(spark, path, "ways").collect()
    assert [(r.way_id, r.tags, r.refs) for r in read_pbf(spark, path, "ways", strict=False).orderBy("way_id").collect()] == [(7, {"a": "2"}, []), (9, {}, [])]
    found = read_pbf(spark, path, "relations").first()
    assert (found.rel_id, found.tags, [tuple(m) for m in found.members]) == (8, {"a": "2", "1": "2"}, [(0, "WAY", 5)])


def test_covering_files(spark, tmp_path):
    deg = lambda *b: tuple(int(x * 1e9) for x in b)
    w.write(tmp_path / "b.osm.pbf", w.frame("OSMHeader", w.header(deg(0, 10, 10, 0))))
    w.write(tmp_path / "a.osm.pbf", w.frame("OSMHeader", w.header(deg(1, 2, 2, 1))))
    w.write(tmp_path / "none.osm.pbf", w.frame("OSMHeader", w.header()))
    w.write(tmp_path / "data.osm.pbf", w.frame("OSMData", w.block([(1, 1, 1)])))
    w.write(tmp_path / "c.OSM.PBF", w.frame("OSMHeader", w.header(deg(0, 10, 10, 0))))
    assert covering_files(spark, str(tmp_path), Box(1, 1, 2, 2)) == [str(tmp_path / "a.osm.pbf"), str(tmp_path / "b.osm.pbf")]
    assert covering_files(spark, str(tmp_path), Box(1, 1, 3, 3)) == [str(tmp_path / "b.osm.pbf")]
    assert np.all([f.endswith("b.osm.pbf") for f in covering_files(spark, str(tmp_path), Box(0, 0, 10, 10))])
