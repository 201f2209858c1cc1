"""Queries of the map operators over the driver's tables, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapframe.functions import geo
from mapframe.functions import style as styles
from mapframe.functions import tags as T
from mapframe.operators import clip as clips
from mapframe.operators import display
from mapframe.operators import ways as W
from mapframe.operators.cache import backdrop_key
from mapframe.operators.coast import coast_rings, dangles
from mapframe.operators.display import backdrop, differences
from mapframe.plans import proxy
from mapframe.plans.proxy import BOX, WORLD, table
from mapframe.schema import Box, Style, Viewport
from mapframe.sources.config import as_number
from mapframe.sources.files import is_map_file

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


_PLACED = "SELECT l_orderkey AS way_id, l_partkey AS node_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS pos FROM lineitem"
_IN_BOX = "CAST(trunc(p_size * 1e9) AS BIGINT) BETWEEN 10000000000 AND 20000000000 AND CAST(trunc(p_retailprice * CAST(1e9 AS DOUBLE)) AS BIGINT) BETWEEN 905000000000 AND 930000000000"
_PIXELS = f"""
  SELECT way_id, pos, (CAST(trunc(p_retailprice * CAST(1e9 AS DOUBLE)) AS BIGINT) * CAST(1e-9 AS DOUBLE) - CAST(900 AS DOUBLE)) * (CAST(396 AS DOUBLE) / CAST(100 AS DOUBLE)) AS x,
    (CAST(trunc(p_size * CAST(1e9 AS DOUBLE)) AS BIGINT) * CAST(1e-9 AS DOUBLE) - CAST(50 AS DOUBLE)) * (CAST(396 AS DOUBLE) / CAST(-49 AS DOUBLE)) AS y
  FROM ({_PLACED}) JOIN part ON p_partkey = node_id
"""


@query(f"""
WITH r AS (SELECT p.* FROM ({_PLACED}) p JOIN orders ON o_orderkey = way_id WHERE o_orderpriority = '1-URGENT'),
hit AS (SELECT DISTINCT way_id FROM r JOIN part ON p_partkey = node_id WHERE {_IN_BOX})
SELECT way_id, pos, CAST(trunc(p_retailprice * CAST(1e9 AS DOUBLE)) AS BIGINT) * CAST(1e-9 AS DOUBLE) AS lon, CAST(trunc(p_size * CAST(1e9 AS DOUBLE)) AS BIGINT) * CAST(1e-9 AS DOUBLE) AS lat
FROM r JOIN part ON p_partkey = node_id WHERE way_id IN (SELECT way_id FROM hit)
""")
def ways_in_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = W.matching(proxy.ways(spark, sf_dir), lambda t: T.tag_is(t, "natural", "1-URGENT"))
    nodes = proxy.nodes(spark, sf_dir)
    refs = proxy.refs(spark, sf_dir).join(wanted.select("path", "way_id"), ["path", "way_id"], "left_semi")
    hit = W.ways_touching(refs, nodes, BOX)
    built = W.assemble_paths(refs.join(hit, ["path", "way_id"], "left_semi"), nodes)
    return built.select("way_id", F.posexplode("points").alias("pos", "p")).select("way_id", "pos", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


@query(f"SELECT DISTINCT l_orderkey AS way_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {_IN_BOX}")
def any_in_box(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(F.lit("parts").alias("path"), F.col("l_orderkey").alias("way_id"), F.col("l_partkey").alias("node_id"))
    return W.ways_touching(refs, proxy.nodes(spark, sf_dir), BOX).select("way_id")


@query(f"SELECT way_id, pos, node_id, CAST(sum(node_id) OVER (PARTITION BY way_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM ({_PLACED})")
def delta_decode(spark, sf_dir):
    order = Window.partitionBy("way_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return proxy.refs(spark, sf_dir).select("way_id", "pos", "node_id", F.sum("node_id").over(order).alias("running"))


@query("SELECT p_partkey AS node_id, round((p_retailprice - CAST(900 AS DOUBLE)) * CAST(396 AS DOUBLE) / CAST(100 AS DOUBLE)) + CAST(0 AS DOUBLE) AS x, round((CAST(p_size AS DOUBLE) - CAST(50 AS DOUBLE)) * CAST(396 AS DOUBLE) / CAST(-49 AS DOUBLE)) + CAST(0 AS DOUBLE) AS y FROM part")
def to_pixel(spark, sf_dir):
    p = geo.to_pixel(F.col("p_retailprice"), F.col("p_size").cast("double"), WORLD)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), p.alias("p")).select("node_id", (F.col("p.x") + geo.num(0)).alias("x"), (F.col("p.y") + geo.num(0)).alias("y"))


@query("SELECT p_partkey AS node_id, CAST(trunc((p_retailprice - CAST(950 AS DOUBLE)) / CAST(7 AS DOUBLE) * CAST(1e9 AS DOUBLE)) AS BIGINT) AS nano FROM part")
def deg_to_nano(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), geo.deg_to_nano((F.col("p_retailprice") - geo.num(950)) / geo.num(7)).alias("nano"))


@query("SELECT p_partkey AS node_id, CAST(trunc(p_retailprice * CAST(1e9 AS DOUBLE)) AS BIGINT) * CAST(1e-9 AS DOUBLE) AS degrees FROM part")
def nano_to_deg(spark, sf_dir):
    return proxy.nodes(spark, sf_dir).select("node_id", geo.nano_to_deg(F.col("lon_nano")).alias("degrees"))


@query("SELECT c_nationkey AS way_id, arg_max(c_name, c_custkey) AS name, arg_max(c_mktsegment, c_custkey) AS segment, max(c_custkey) AS file_ordinal FROM customer GROUP BY c_nationkey")
def last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("way_id"), F.col("c_custkey").alias("file_ordinal"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return W.last_wins(rows, ["way_id"])


@query("""
WITH u AS (
  SELECT o_orderkey AS way_id, 'natural' AS key, c_mktsegment AS value FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT o_orderkey, 'owner', c_name FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT o_orderkey, 'landuse', o_orderstatus FROM orders
  UNION ALL SELECT o_orderkey, 'natural', o_orderpriority FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
)
SELECT * FROM u
""")
def tag_merge(spark, sf_dir):
    merged = W.overlay_relations(proxy.ways(spark, sf_dir), proxy.relations(spark, sf_dir))
    return merged.select("way_id", F.explode("tags").alias("key", "value"))


@query("SELECT event_id, CAST(coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) AS DOUBLE) AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", as_number(F.from_json("props", "struct<k:string>")["k"]).alias("k"))


@query("SELECT p_partkey AS node_id, sha256(concat_ws('|', CAST(p_size AS VARCHAR), p_brand, p_type)) AS digest FROM part")
def sha256_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.sha2(F.concat_ws("|", F.col("p_size").cast("string"), "p_brand", "p_type"), 256).alias("digest"))


#: The box (1, 900, 50, 1000) as four doubles, the size (396, 396) as two 32-bit integers, the colour 0xFFA1C5ED of the
#: water and a 1 for water in front, all little-endian.
_KEY_BYTES = "000000000000F03F" "0000000000208C40" "0000000000004940" "0000000000408F40" "8C010000" "8C010000" "EDC5A1FF" "01"


@query(f"SELECT r_regionkey AS idx, sha256(unhex('{_KEY_BYTES}')) AS key FROM region")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("idx"), F.lit(backdrop_key(WORLD, Style())).alias("key"))


@query("""
WITH t AS (SELECT s_suppkey AS tile, s_suppkey % 5 + 3 AS k FROM supplier)
SELECT tile, CAST(p AS INTEGER) AS pos, CAST((k - 1 + p) % k + 1 AS DOUBLE) AS x, CAST(((k - 1 + p) % k) * ((k - 1 + p) % k) + 1 AS DOUBLE) AS y
FROM (SELECT tile, k, unnest(range(0, k + 1)) AS p FROM t)
""")
def coast_chain(spark, sf_dir):
    """Rings of three to seven points in pieces of one segment, the last first: the first part is the one that ends them."""
    k = F.col("s_suppkey") % 5 + 3
    corner = lambda i: geo.point(i + 1, i * i + 1)
    pieces = F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda n: F.array(corner(k - 1 - n), corner(F.pmod(k - n, k)))))
    parts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tile"), F.lit("parts").alias("path"), pieces.alias("sub", "points")).withColumn("way_id", F.col("sub"))
    made = coast_rings(parts, 50, 50, ["tile"])
    return made.select("tile", F.posexplode("points").alias("pos", "p")).select("tile", "pos", "p.x", "p.y")


@query("""
WITH c AS (SELECT s_suppkey AS tile, CAST(s_suppkey % 29 + 1 AS DOUBLE) AS a, CAST(s_nationkey + 1 AS DOUBLE) AS b FROM supplier),
p AS (SELECT tile, [{'x': CAST(0 AS DOUBLE), 'y': a}, {'x': CAST(20 AS DOUBLE), 'y': CAST(5 AS DOUBLE)}, {'x': CAST(40 AS DOUBLE), 'y': b}]
  || CASE WHEN a <> b THEN [{'x': CAST(40 AS DOUBLE), 'y': CAST(30 AS DOUBLE)}, {'x': CAST(0 AS DOUBLE), 'y': CAST(30 AS DOUBLE)}] ELSE [] END || [{'x': CAST(0 AS DOUBLE), 'y': a}] AS p FROM c)
SELECT tile, CAST(i - 1 AS INTEGER) AS pos, p[i].x AS x, p[i].y AS y FROM (SELECT tile, p, unnest(range(1, len(p) + 1)) AS i FROM p)
""")
def coast_edges(spark, sf_dir):
    """A coast from the left edge to the right one in two pieces beyond the picture: clipped, chained and closed below."""
    a, b = (F.col("s_suppkey") % 29 + 1).cast("double"), (F.col("s_nationkey") + 1).cast("double")
    pieces = F.array(F.array(geo.point(geo.num(20), geo.num(5)), geo.point(geo.num(40), b), geo.point(geo.num(60), b)), F.array(geo.point(geo.num(-9), a), geo.point(geo.num(0), a), geo.point(geo.num(20), geo.num(5))))
    paths = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tile"), F.lit("parts").alias("path"), F.posexplode(pieces).alias("n", "points")).withColumn("way_id", -F.col("n"))
    made = coast_rings(clips.clip(paths, 40, 30, ["tile", "path", "way_id"]), 40, 30, ["tile"])
    return made.select("tile", F.posexplode("points").alias("pos", "p")).select("tile", "pos", "p.x", "p.y")


@query(f"""
WITH s AS (SELECT way_id, pos, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM ({_PIXELS}) WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
i AS (SELECT way_id, pos, x BETWEEN 0 AND 200 AND y BETWEEN 0 AND 200 AS a, bx BETWEEN 0 AND 200 AND by_ BETWEEN 0 AND 200 AS b FROM s WHERE bx IS NOT NULL AND (x <> bx OR y <> by_))
SELECT way_id, CAST(count(*) AS BIGINT) AS inside FROM i WHERE a AND b GROUP BY way_id
""")
def clip_parts(spark, sf_dir):
    """Segments that lie within the picture as a whole, counted in the parts that clipping leaves of each way."""
    made = clips.clip(proxy.paths(spark, sf_dir), 200, 200, ["way_id"])
    kept = clips.segments(made, ["way_id", "sub"]).select("way_id", geo.point(F.col("ax"), F.col("ay")).alias("a"), geo.point(F.col("bx"), F.col("by")).alias("b")).where("a <> b")
    whole = clips.segments(proxy.paths(spark, sf_dir), ["way_id"]).select("way_id", "seg", geo.point(F.col("ax"), F.col("ay")).alias("a"), geo.point(F.col("bx"), F.col("by")).alias("b"))
    found = whole.join(kept.distinct(), ["way_id", "a", "b"], "left_semi")
    return found.groupBy("way_id").agg(F.count("*").alias("inside"))


@query("SELECT n_nationkey AS idx, CAST((((CAST(4289644257 AS BIGINT) + n_nationkey) >> 1) & 2139062143) + ((CAST(4292798961 AS BIGINT) >> 1) & 2139062143) AS BIGINT) AS color FROM nation")
def color_average(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), styles.mean_color(F.lit(4289644257).cast("long") + F.col("n_nationkey"), F.lit(4292798961).cast("long")).alias("color"))


@query(f"SELECT way_id, pos AS seg, node_id AS a, next AS b FROM (SELECT way_id, pos, node_id, lead(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS next FROM ({_PLACED})) WHERE next IS NOT NULL")
def segment_pairs(spark, sf_dir):
    nxt = F.lead("node_id").over(Window.partitionBy("way_id").orderBy("pos"))
    return proxy.refs(spark, sf_dir).select("way_id", F.col("pos").alias("seg"), F.col("node_id").alias("a"), nxt.alias("b")).where("b is not null")


_SMALL = (100.0, 80.0)


@query(f"""
WITH s AS (
  SELECT way_id, pos AS seg, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM ({_PIXELS}) WINDOW w AS (PARTITION BY way_id ORDER BY pos)
), d AS (
  SELECT *, bx - ax AS dx, by_ - ay AS dy FROM s WHERE bx IS NOT NULL
), t AS (
  SELECT way_id, seg,
    greatest(CAST(0 AS DOUBLE), CASE WHEN dx = 0 THEN CASE WHEN ax < 0 OR ax > 100 THEN 2.0 ELSE 0.0 END ELSE least((0 - ax) / dx, (CAST(100 AS DOUBLE) - ax) / dx) END,
      CASE WHEN dy = 0 THEN CASE WHEN ay < 0 OR ay > 80 THEN 2.0 ELSE 0.0 END ELSE least((0 - ay) / dy, (CAST(80 AS DOUBLE) - ay) / dy) END) AS t0,
    least(CAST(1 AS DOUBLE), CASE WHEN dx = 0 THEN 1.0 ELSE greatest((0 - ax) / dx, (CAST(100 AS DOUBLE) - ax) / dx) END,
      CASE WHEN dy = 0 THEN 1.0 ELSE greatest((0 - ay) / dy, (CAST(80 AS DOUBLE) - ay) / dy) END) AS t1 FROM d
)
SELECT way_id, seg, round(CAST(t0 AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS t0, round(CAST(t1 AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS t1 FROM t WHERE t0 < t1
""")
def clip_segments(spark, sf_dir):
    s = clips.segments(proxy.paths(spark, sf_dir), ["way_id"])
    low, high = clips.cut(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), *_SMALL)
    s = s.withColumns({"t0": low, "t1": high}).where("t0 < t1")
    return s.select("way_id", "seg", (F.round("t0", 6) + geo.num(0)).alias("t0"), (F.round("t1", 6) + geo.num(0)).alias("t1"))


_ON_EDGE = """
SELECT p_partkey AS node_id, p_partkey % 4 AS e,
  CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN CAST(396 AS DOUBLE) WHEN 2 THEN CAST(p_size AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x,
  CASE p_partkey % 4 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN CAST(290 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS y FROM part
"""


def _on_edge(spark, sf_dir):
    k, s = F.col("p_partkey") % 4, F.col("p_size").cast("double")
    x = F.when(k.isin(0, 2), s).when(k == 1, geo.num(396)).otherwise(geo.num(0))
    y = F.when(k.isin(1, 3), s).when(k == 2, geo.num(290)).otherwise(geo.num(0))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), x.alias("x"), y.alias("y"))


@query(f"SELECT node_id, CAST(e AS INTEGER) AS edge FROM ({_ON_EDGE})")
def edge_id(spark, sf_dir):
    return _on_edge(spark, sf_dir).select("node_id", geo.edge_id(F.col("x"), F.col("y"), 396, 290).alias("edge"))


@query(f"SELECT node_id, CASE e WHEN 0 THEN x WHEN 1 THEN 396 + y WHEN 2 THEN 396 + 290 + 396 - x ELSE 396 + 290 + 396 + 290 - y END AS way FROM ({_ON_EDGE})")
def perimeter_pos(spark, sf_dir):
    return _on_edge(spark, sf_dir).select("node_id", geo.perimeter_pos(F.col("x"), F.col("y"), 396, 290).alias("way"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(((b.n_nationkey % 4) - (a.n_nationkey % 4) + 4) % 4 AS INTEGER) AS corners FROM nation a, nation b")
def corners_between(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    pairs = n.select(F.col("n_nationkey").alias("a")).join(F.broadcast(n.select(F.col("n_nationkey").alias("b"))))  # 25 by 25 rows
    return pairs.select("a", "b", F.size(geo.corners_between(F.col("a") % 4, F.col("b") % 4, 396, 290)).alias("corners"))


@query("""
WITH n AS (SELECT s_suppkey AS i, s_nationkey AS g, CAST((s_suppkey * 37) % 1000 AS DOUBLE) AS st, CAST((s_suppkey * 91) % 1000 AS DOUBLE) AS en FROM supplier),
p AS (SELECT a.g, a.i, b.i AS j, CASE WHEN b.st < a.en THEN b.st - a.en + 1000 ELSE b.st - a.en END AS ahead FROM n a JOIN n b ON a.g = b.g)
SELECT i, j AS nearest, ahead FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY ahead, j) AS r FROM p) WHERE r = 1
""")
def nearest_next(spark, sf_dir):
    i, ring = F.col("s_suppkey"), geo.num(1000)
    n = table(spark, sf_dir, "supplier").select(i.alias("i"), F.col("s_nationkey").alias("g"), ((i * 37) % 1000).cast("double").alias("st"), ((i * 91) % 1000).cast("double").alias("en"))
    # Starts and ends of a group, the farthest first and a start before an end at its place: the least start so far is the
    # nearest one at or after an end; where there is none, the least of all, around.
    none = F.lit(None).cast("struct<st:double,i:bigint>")
    starts = n.select("g", F.col("st").alias("at"), F.lit(0).alias("kind"), F.struct("st", "i").alias("s"), F.lit(None).cast("bigint").alias("i"))
    both = starts.unionByName(n.select("g", F.col("en").alias("at"), F.lit(1).alias("kind"), none.alias("s"), "i"))
    order = Window.partitionBy("g").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"b": F.min("s").over(order), "least": F.min("s").over(Window.partitionBy("g"))}).where("kind = 1").withColumn("b", F.coalesce("b", "least"))
    ahead = F.col("b.st") - F.col("at")
    return found.select("i", F.col("b.i").alias("nearest"), F.when(ahead < 0, ahead + ring).otherwise(ahead).alias("ahead"))


@query("SELECT m AS mode, n_nationkey AS active FROM nation, (SELECT unnest(['HOVER', 'ACTIVE']) AS m) UNION ALL SELECT 'BASE', -1 UNION ALL SELECT 'CALLOUT', n_nationkey FROM nation")
def mode_cross(spark, sf_dir):
    return display.modes_of(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx")), display.MODES)


@query("SELECT l_partkey AS node_id FROM lineitem WHERE l_quantity < 10 UNION SELECT p_partkey FROM part WHERE p_size < 10")
def id_union(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_quantity < 10").select(F.col("l_partkey").alias("node_id"))
    return a.union(table(spark, sf_dir, "part").where("p_size < 10").select("p_partkey")).distinct()


@query("SELECT o_orderkey AS way_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def discard_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way_id"))
    return orders.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id")), "way_id", "left_anti")


@query("SELECT path FROM (SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN '.osm.pbf' WHEN n_nationkey % 3 = 0 THEN '.OSM.PBF' ELSE '.pbf' END AS path FROM nation) WHERE suffix(path, '.osm.pbf')")
def suffix_filter(spark, sf_dir):
    k = F.col("n_nationkey")
    name = F.concat("n_name", F.when(k % 2 == 0, ".osm.pbf").when(k % 3 == 0, ".OSM.PBF").otherwise(".pbf"))
    return table(spark, sf_dir, "nation").select(name.alias("path")).where(is_map_file(F.col("path")))


@query("SELECT n_nationkey AS idx, 'city-' || lpad(CAST(n_nationkey * 7 AS VARCHAR), CAST(greatest(2, length(CAST(n_nationkey * 7 AS VARCHAR))) AS INTEGER), '0') || '-callout.png' AS file FROM nation")
def output_name(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), styles.callout_name("city", F.col("n_nationkey") * 7).alias("file"))


@query("""
WITH b AS (SELECT p_partkey AS node_id, CAST(p_size AS DOUBLE) * 8 AS cx, (p_retailprice - 900) * 4 AS cy, CAST(length(p_name) AS DOUBLE) * 3 AS w, CAST(11 AS DOUBLE) AS h FROM part),
lo AS (SELECT *, greatest(cx - w * 0.5, 2) AS x0, greatest(cy - h * 0.5, 2) AS y0 FROM b),
hi AS (SELECT node_id, w, h, CASE WHEN x0 + w > 394 THEN 396 - w - 2 ELSE x0 END AS x0, CASE WHEN y0 + h > 394 THEN 396 - h - 2 ELSE y0 END AS y0 FROM lo)
SELECT node_id, CAST(floor(x0) AS DOUBLE) AS x, CAST(floor(y0) AS DOUBLE) AS y, CAST(ceil(x0 + w) - floor(x0) AS DOUBLE) AS w, CAST(ceil(y0 + h) - floor(y0) AS DOUBLE) AS h FROM hi
""")
def label_clamp(spark, sf_dir):
    box = geo.label_box(F.col("p_size").cast("double") * 8, (F.col("p_retailprice") - 900) * 4, F.length("p_name").cast("double") * 3, geo.num(11), WORLD)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), box.alias("b")).select("node_id", "b.*")


@query("""
WITH f AS (SELECT s_nationkey AS file, min(s_acctbal) AS x0, max(s_acctbal) AS x1, CAST(min(s_suppkey) AS DOUBLE) AS y0, CAST(max(s_suppkey) AS DOUBLE) AS y1 FROM supplier GROUP BY s_nationkey)
SELECT file FROM f WHERE x0 <= 4000 AND x1 >= 5000 AND y0 <= 60 AND y1 >= 61 AND x0 < x1 AND y0 < y1
""")
def rect_contains(spark, sf_dir):
    k = F.col("s_suppkey").cast("double")
    f = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("file")).agg(F.min("s_acctbal").alias("x0"), F.min(k).alias("y0"), F.max("s_acctbal").alias("x1"), F.max(k).alias("y1"))
    return f.where(geo.contains(tuple(map(F.col, ("x0", "y0", "x1", "y1"))), tuple(map(geo.num, (4000, 60, 5000, 61))))).select("file")


_EVENT_TAGS = {"view": ("natural", "water"), "click": ("landuse", "reservoid"), "purchase": ("waterway", "river"), "signup": ("bridge", "no"), "error": ("natural", "coastline")}


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'bridge' WHEN 'error' THEN 'coast' END AS kind, event_type IN ('view', 'click') AS is_water, event_type <> 'purchase' AS shown FROM events")
def water_class(spark, sf_dir):
    tags = F.create_map()
    for event, (key, value) in _EVENT_TAGS.items():
        tags = F.when(F.col("event_type") == event, F.create_map(F.lit(key), F.lit(value))).otherwise(tags.cast("map<string,string>"))
    t = F.col("tags")
    return table(spark, sf_dir, "events").select("event_id", tags.alias("tags")).select("event_id", T.kind(t).alias("kind"), T.is_water(t).alias("is_water"), T.render_filter(t).alias("shown"))


@query(f"SELECT p_partkey AS node_id FROM part WHERE {_IN_BOX}")
def bbox_points(spark, sf_dir):
    return proxy.nodes(spark, sf_dir).where(geo.in_box(F.col("lat_nano"), F.col("lon_nano"), BOX)).select("node_id")


@query("SELECT o_orderkey AS way_id, o_orderpriority AS v, o_orderpriority IN ('1-URGENT', '2-HIGH') AS high, CAST(NULL AS VARCHAR) AS missing, false AS has_missing FROM orders")
def tag_lookup(spark, sf_dir):
    t = F.col("tags")
    return proxy.ways(spark, sf_dir).select("way_id", T.tag(t, "natural").alias("v"), T.tag_is(t, "natural", "1-URGENT", "2-HIGH").alias("high"), T.tag(t, "none").alias("missing"), T.has_tag(t, "none").alias("has_missing"))


@query("SELECT l_orderkey AS way_id, count(*) AS refs, count(p_partkey) FILTER (p_partkey % 3 <> 0) AS placed FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def strict_coord_join(spark, sf_dir):
    """Every third node is missing, which leaves out its vertices where the assembly is not strict."""
    refs = proxy.refs(spark, sf_dir)
    built = W.assemble_paths(refs, proxy.nodes(spark, sf_dir).where("node_id % 3 <> 0"), strict=False)
    return refs.groupBy("way_id").agg(F.count("*").alias("refs")).join(built.select("way_id", F.size("points").cast("long").alias("placed")), "way_id")


@query(f"SELECT way_id, count(*) AS n, string_agg(CAST(p_size AS VARCHAR), ',' ORDER BY pos) AS latitudes FROM ({_PLACED}) JOIN part ON p_partkey = node_id GROUP BY way_id")
def path_assemble(spark, sf_dir):
    built = W.assemble_paths(proxy.refs(spark, sf_dir), proxy.nodes(spark, sf_dir))
    return built.select("way_id", F.size("points").cast("long").alias("n"), F.array_join(F.transform("points", lambda p: F.round(p["y"]).cast("long").cast("string")), ",").alias("latitudes"))


@query("SELECT o_custkey AS rel_id, o_orderkey AS ref FROM orders JOIN customer ON c_custkey = o_custkey")
def member_filter(spark, sf_dir):
    return proxy.relations(spark, sf_dir).select("rel_id", F.explode("members").alias("m")).where(F.col("m.type") == "WAY").select("rel_id", F.col("m.ref").alias("ref"))


@query("SELECT min(n_nationkey) AS file FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def first_nonempty(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return table(spark, sf_dir, "nation").join(rich, "n_nationkey", "left_semi").agg(F.min("n_nationkey").alias("file"))


@query("SELECT n_nationkey AS idx, n_name AS name, n_nationkey = 3 AS is_active FROM nation")
def area_ordinal(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy().agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("a"))  # the areas of one city
    return rows.select(F.posexplode("a").alias("idx", "a")).select("idx", F.col("a.n_name").alias("name"), (F.col("idx") == 3).alias("is_active"))


@query("SELECT p_partkey AS node_id, CAST(i - 1 AS INTEGER) AS line, parts[i] AS label FROM (SELECT p_partkey, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT p_partkey, string_split(p_name, ' ') AS parts FROM part))")
def label_split(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.posexplode(F.split("p_name", " ")).alias("line", "label"))


@query(f"""
WITH e AS (SELECT way_id, arg_min({{'x': x, 'y': y}}, pos) AS a, arg_max({{'x': x, 'y': y}}, pos) AS b FROM ({_PIXELS}) GROUP BY way_id)
SELECT way_id, a = b AS is_closed FROM e WHERE a = b OR NOT ((a.x > 0 AND a.y > 0 AND a.x < 200 AND a.y < 200) OR (b.x > 0 AND b.y > 0 AND b.x < 200 AND b.y < 200))
""")
def dangling_drop(spark, sf_dir):
    points = F.col("points")
    return proxy.paths(spark, sf_dir).where(~dangles(points, 200, 200)).select("way_id", geo.is_closed(points).alias("is_closed"))


@query("""
WITH c AS (SELECT n_nationkey AS idx, CAST(n_nationkey AS BIGINT) * 123456789 + 7 AS v FROM nation)
SELECT idx, 'hex' AS form, CAST(v & 4294967295 AS BIGINT) AS color FROM c
UNION ALL SELECT idx, 'decimal', CAST(v & 4294967295 AS BIGINT) FROM c
UNION ALL SELECT idx, 'octal', CAST(7 AS BIGINT) FROM c UNION ALL SELECT idx, 'junk', CAST(0 AS BIGINT) FROM c
""")
def color_parse(spark, sf_dir):
    v = F.col("n_nationkey").cast("long") * 123456789 + 7
    forms = {"hex": F.concat(F.lit("0x"), F.lower(F.hex(v))), "decimal": v.cast("string"), "octal": F.lit("07f0000000"), "junk": F.lit("red")}
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("form"), c.alias("text")) for k, c in forms.items())))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), rows.alias("r")).select("idx", "r.form", styles.parse_color(F.col("r.text")).alias("color"))


@query("SELECT c_custkey AS idx, least(c_acctbal, CAST(c_custkey AS DOUBLE)) AS low, greatest(c_acctbal, CAST(c_custkey AS DOUBLE)) AS high, greatest(c_acctbal, CAST(c_custkey AS DOUBLE)) - least(c_acctbal, CAST(c_custkey AS DOUBLE)) AS size FROM customer")
def bounds_normalise(spark, sf_dir):
    a, b = F.col("c_acctbal"), F.col("c_custkey").cast("double")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), (F.greatest(a, b) - F.least(a, b)).alias("size"))


_S = Style()


@query(f"""
SELECT n_nationkey AS idx, m AS mode,
  CAST(CASE WHEN n_nationkey = 4 AND m IN ('ACTIVE', 'CALLOUT') THEN {_S.active_area} WHEN n_nationkey = 4 AND m = 'HOVER' THEN CASE WHEN n_regionkey = 2 THEN {_S.hover_park} ELSE {_S.hover_area} END
    WHEN n_regionkey = 2 THEN {_S.park} ELSE {_S.inactive_area} END AS BIGINT) AS color,
  concat_ws(' ', 'Arial', CASE WHEN n_regionkey <> 2 THEN 'Bold' END, CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey < 11 THEN 'light' END) AS font
FROM nation, (SELECT unnest(['BASE', 'HOVER', 'ACTIVE', 'CALLOUT']) AS m)
""")
def style_case(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.explode(F.array(*map(F.lit, ("BASE", "HOVER", "ACTIVE", "CALLOUT")))).alias("mode"))
    k, kind = F.col("n_nationkey"), F.col("n_regionkey")
    return n.select(k.alias("idx"), "mode", styles.area_color(kind, F.col("mode"), k == 4, _S).cast("long").alias("color"), styles.font(k, kind != 2).alias("font"))


@query("SELECT p_partkey AS id, 'coast' AS layer FROM part WHERE p_size < 5 UNION ALL SELECT p_partkey, 'bridge' FROM part WHERE p_size < 10")
def append_all(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    one = lambda n, layer: part.where(F.col("p_size") < n).select(F.col("p_partkey").alias("id"), F.lit(layer).alias("layer"))
    return one(5, "coast").unionByName(one(10, "bridge"))


@query("""
WITH c AS (SELECT c_nationkey AS tile, c_mktsegment AS cmd, c_custkey % 2 AS z, c_acctbal > 0 AS base FROM customer)
SELECT tile, cmd, z FROM c WHERE NOT base AND NOT EXISTS (SELECT 1 FROM c b WHERE b.base AND b.tile = c.tile AND b.cmd = c.cmd AND b.z = c.z)
""")
def image_diff(spark, sf_dir):
    none = lambda t: F.lit(None).cast(t)
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").alias("tile"), F.when(F.col("c_acctbal") > 0, "BASE").otherwise("HOVER").alias("mode"), none("int").alias("area_idx"), (F.col("c_custkey") % 2).alias("z"), F.col("c_mktsegment").alias("cmd"), none("long").alias("color"), none("double").alias("width"), F.lit("over").alias("op"), none("string").alias("text"), F.array(geo.point(geo.num(1), geo.num(2))).alias("points"))
    return differences(rows).select("tile", "cmd", "z")


@query(f"SELECT DISTINCT l_partkey AS node_id FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {_IN_BOX})")
def closure_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(F.lit("parts").alias("path"), F.col("l_orderkey").alias("way_id"), F.col("l_partkey").alias("node_id"))
    hit = W.ways_touching(refs, proxy.nodes(spark, sf_dir), BOX)
    return refs.join(hit, ["path", "way_id"], "left_semi").select("node_id").distinct()


@query("SELECT n_nationkey AS id, n_name AS key, r_name AS value FROM nation JOIN region ON r_regionkey = n_regionkey")
def string_lookup(spark, sf_dir):
    strings = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("value"))
    return table(spark, sf_dir, "nation").join(strings, "n_regionkey").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("key"), "value")


@query("SELECT o_orderpriority AS tag, count(*) AS n FROM orders GROUP BY o_orderpriority")
def ways_count(spark, sf_dir):
    return proxy.ways(spark, sf_dir).groupBy(F.col("tags")["natural"].alias("tag")).agg(F.count("*").alias("n"))


@query(f"""
WITH p AS (
  SELECT way_id, count(*) AS n, arg_min({{'x': x, 'y': y}}, pos) = arg_max({{'x': x, 'y': y}}, pos) AS closed FROM ({_PIXELS}) GROUP BY way_id
), w AS (SELECT p.*, o_orderpriority AS priority, o_orderstatus AS status FROM p JOIN orders ON o_orderkey = way_id)
SELECT CAST(1 AS INTEGER) AS layer, 'fill' AS cmd, CAST({Style().water} AS BIGINT) AS color, CAST(NULL AS DOUBLE) AS width, 'over' AS op, CAST(n + CASE WHEN closed THEN 0 ELSE 1 END AS INTEGER) AS points, count(*) AS ways FROM w WHERE priority = '1-URGENT' GROUP BY ALL
UNION ALL SELECT 2, 'stroke', 4294967295, 2, 'dest_out', CAST(n AS INTEGER), count(*) FROM w WHERE status = 'P' GROUP BY ALL
""")
def layers(spark, sf_dir):
    """The backdrop of water ways and bridges, counted by the form of its commands."""
    tags = F.filter(F.array(F.when(T.tag_is(F.col("tags"), "natural", "1-URGENT"), F.struct(F.lit("natural").alias("key"), F.lit("water").alias("value"))), F.when(T.tag_is(F.col("tags"), "landuse", "P"), F.struct(F.lit("bridge").alias("key"), F.lit("yes").alias("value")))), lambda t: t.isNotNull())
    built = W.assemble_paths(proxy.refs(spark, sf_dir), proxy.nodes(spark, sf_dir))
    ways = proxy.ways(spark, sf_dir).select("way_id", F.map_from_entries(tags).alias("tags")).join(built, "way_id")
    made = backdrop(ways, WORLD, Style())
    return made.groupBy(F.shiftright("z", 32).cast("int").alias("layer"), "cmd", "color", "width", "op", F.size("points").alias("points")).agg(F.count("*").alias("ways"))


_LAYER = 4294967296


@query(f"""
WITH m AS (SELECT 'BASE' AS mode, -1 AS active UNION ALL SELECT unnest(['HOVER', 'ACTIVE', 'CALLOUT']), n_nationkey FROM nation),
d AS (SELECT m.*, n_nationkey AS idx, n_regionkey AS type, n_name AS name, n_nationkey = active AS chosen FROM m, nation),
l AS (SELECT m.*, s_suppkey AS idx, s_name AS label FROM m, supplier WHERE s_suppkey % 5 = 0)
SELECT mode, active, CAST(0 AS BIGINT) AS z, 'rect' AS cmd, CAST({Style().land} AS BIGINT) AS color, CAST(NULL AS DOUBLE) AS width, 'over' AS op, CAST(NULL AS VARCHAR) AS text, 2 AS points FROM m
UNION ALL SELECT mode, active, 2 * {_LAYER} + idx, 'fill_masked', CASE WHEN chosen AND mode IN ('ACTIVE', 'CALLOUT') THEN {Style().active_area}
  WHEN chosen AND mode = 'HOVER' THEN CASE WHEN type = 2 THEN {Style().hover_park} ELSE {Style().hover_area} END WHEN type = 2 THEN {Style().park} ELSE {Style().inactive_area} END, NULL, 'over', NULL, 3 FROM d
UNION ALL SELECT mode, active, 3 * {_LAYER} + idx, 'mask_stroke', NULL, 3, 'dest_out', NULL, 3 FROM d
UNION ALL SELECT mode, active, 5 * {_LAYER} + 2 * idx, 'icon', NULL, NULL, 'over', 'park', 1 FROM d WHERE type = 2
UNION ALL SELECT mode, active, 5 * {_LAYER} + 2 * idx, 'rect_round', {Style().active_label_background}, 4, 'over', NULL, 2 FROM d WHERE type <> 2 AND chosen AND mode = 'HOVER'
UNION ALL SELECT mode, active, 5 * {_LAYER} + 2 * idx + 1, 'text', CASE WHEN chosen AND mode = 'HOVER' THEN {Style().active_label} ELSE {Style().inactive_label} END, NULL, 'over', name, 2 FROM d WHERE type <> 2
UNION ALL SELECT mode, active, 6 * {_LAYER} + 2 * idx, 'text', {Style().landmark_label}, NULL, 'over', label, 1 FROM l
UNION ALL SELECT mode, active, 6 * {_LAYER} + 2 * idx + 1, 'rect', {Style().landmark_bullet}, NULL, 'over', NULL, 2 FROM l
""")
def display_list(spark, sf_dir):
    """Every command of all four modes: areas, parks, labels and landmarks, of which every fifth is shown."""
    zero = F.array(geo.point(geo.num(0), geo.num(0)), geo.point(geo.num(1), geo.num(1)))
    areas = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("type"), geo.point(geo.num(950), geo.num(20)).alias("center"), zero.alias("points"))
    k = F.col("s_suppkey")
    marks = table(spark, sf_dir, "supplier").select(k.alias("idx"), (k % 5 == 0).alias("display"), geo.num(910).alias("lon"), geo.num(30).alias("lat"), F.col("s_name").alias("label"))
    made = display.display_list(None, areas, marks, Viewport(Box(1, 900, 50, 1000)), Style(), display.MODES)
    return made.select("mode", F.col("area_idx").alias("active"), "z", "cmd", "color", "width", "op", "text", F.size("points").alias("points"))
