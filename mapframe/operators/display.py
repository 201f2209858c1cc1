"""Pictures as tables: one row a drawing command, with its place in the order of painting.

``tile, mode, area_idx, z, cmd, color, width, op, text, points``: a tile is one size of picture, a mode one state of it, ``z``
orders the commands of a picture, ``points`` is in pixels. Coordinates of rectangles are their upper left and lower
right corner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapframe.functions import geo, style as styles, tags as T
from mapframe.operators.clip import clip
from mapframe.operators.coast import coast_rings
from mapframe.schema import Style, Viewport

COLUMNS = ("tile", "mode", "area_idx", "z", "cmd", "color", "width", "op", "text", "points")
MODES = ("BASE", "HOVER", "ACTIVE", "CALLOUT")
#: Layers in the order of painting; commands of a layer follow their own order within it.
LAYERS = ("land", "backdrop_behind", "areas", "mask_outline", "backdrop_front", "labels", "landmarks")
_STEP = 1 << 32


def _z(layer: int, within: Column) -> Column:
    return F.lit(layer * _STEP) + within.cast("long")


def command(z: Column, cmd: str, points: Column, color: Column | None = None, width: float | None = None, op: str = "over", text: Column | None = None) -> list[Column]:
    none = lambda t: F.lit(None).cast(t)
    return [z.cast("long").alias("z"), F.lit(cmd).alias("cmd"), (none("long") if color is None else color.cast("long")).alias("color"), F.lit(width).cast("double").alias("width"), F.lit(op).alias("op"), (none("string") if text is None else text).alias("text"), points.alias("points")]


def _rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(geo.point(x0, y0), geo.point(x1, y1))


def backdrop(ways: DataFrame, view: Viewport, style: Style, correct: bool = False) -> DataFrame:
    """Water and what crosses it: coast polygons in one fill, water ways closed, bridges erased.

    ``ways``: ``path, way_id, tags, points`` in degrees. A way may be water and a bridge; a bridge is no coast.
    """
    placed = ways.select("path", "way_id", T.kind(F.col("tags")).alias("kind"), T.is_water(F.col("tags")).alias("is_water"), geo.scale(geo.translate(F.col("points"), view), view).alias("points"))
    coast = placed.where(F.col("kind") == "coast").withColumn("tile", F.lit(view.width))
    ring = coast_rings(clip(coast, view.width, view.height, ["tile", "path", "way_id"]), view.width, view.height, ["tile"], correct)
    number = F.pmod(F.xxhash64("path", "way_id"), F.lit(_STEP))
    layers = [
        ring.select(*command(_z(0, F.col("ring")), "fill_multi", F.col("points"), F.lit(style.water))),
        placed.where("is_water").select(*command(_z(1, number), "fill", geo.closed(F.col("points")), F.lit(style.water))),
        placed.where(F.col("kind") == "bridge").select(*command(_z(2, number), "stroke", F.col("points"), F.lit(0xFFFFFFFF), 2.0, "dest_out")),
    ]
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out


def modes_of(areas: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """``mode, active``: the base picture once, each other mode for each area."""
    spark = areas.sparkSession
    each = [m for m in modes if m != "BASE"]
    out = spark.range(1).select(F.lit("BASE").alias("mode"), F.lit(-1).alias("active")) if "BASE" in modes else None
    if each:
        rest = areas.select(F.explode(F.array(*map(F.lit, each))).alias("mode"), F.col("idx").cast("int").alias("active"))
        out = rest if out is None else out.unionByName(rest)
    return out


#: Pictures of a tile that are broadcast at most, five numbers each.
MOST_PICTURES = 100_000


def _counted(chosen: DataFrame) -> DataFrame:
    """The pictures, to be broadcast if they were counted to be few; the product with them is the result all the same."""
    return F.broadcast(chosen) if chosen.limit(MOST_PICTURES + 1).count() <= MOST_PICTURES else chosen


def area_pictures(areas: DataFrame, landmarks: DataFrame, view: Viewport, style: Style, modes: tuple[str, ...]) -> DataFrame:
    """The pictures of a tile without its backdrop, which :func:`display_list` puts behind or in front of the areas."""
    chosen = modes_of(areas, modes)
    whole = _rect(geo.num(0), geo.num(0), geo.num(view.width), geo.num(view.height))
    pixel = geo.scale(geo.translate(F.col("points"), view), view)
    on = F.col("idx") == F.col("active")
    drawn = areas.crossJoin(_counted(chosen))  # a city's modes by its areas: the product is the result
    center = geo.to_pixel(F.col("center.x"), F.col("center.y"), view)
    w, h = geo.text_extent(F.col("name"), view.font_size)
    box = geo.label_box(F.col("c.x"), F.col("c.y"), w, h, view)
    labels = drawn.where("type <> 2").withColumn("c", center).withColumn("box", box)
    hover = on & (F.col("mode") == "HOVER")
    grown = geo.inset(F.col("box"), -3.0)
    corners = lambda b: _rect(b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"])
    mark = landmarks.where("display").withColumn("c", geo.to_pixel(F.col("lon"), F.col("lat"), view)).crossJoin(_counted(chosen))
    _, mark_h = geo.text_extent(F.col("label"), view.font_size)
    half = view.bullet // 2
    parts = [
        chosen.select("mode", "active", *command(_z(0, F.lit(0)), "rect", whole, F.lit(style.land))),
        drawn.select("mode", "active", *command(_z(2, F.col("idx")), "fill_masked", geo.closed(pixel), styles.area_color(F.col("type"), F.col("mode"), on, style))),
        drawn.select("mode", "active", *command(_z(3, F.col("idx")), "mask_stroke", geo.closed(pixel), None, 3.0, "dest_out")),
        drawn.where("type = 2").withColumn("c", center).select("mode", "active", *command(_z(5, F.col("idx") * 2), "icon", F.array("c"), text=F.lit("park"))),
        labels.where(hover).select("mode", "active", *command(_z(5, F.col("idx") * 2), "rect_round", corners(grown), F.lit(style.active_label_background), 4.0)),
        labels.select("mode", "active", *command(_z(5, F.col("idx") * 2 + 1), "text", corners(F.col("box")), F.when(hover, F.lit(style.active_label)).otherwise(F.lit(style.inactive_label)), text=F.col("name"))),
        mark.select("mode", "active", *command(_z(6, F.col("idx") * 2), "text", F.array(geo.point(F.col("c.x") + view.bullet, F.col("c.y") - mark_h / 2)), F.lit(style.landmark_label), text=F.col("label"))),
        mark.select("mode", "active", *command(_z(6, F.col("idx") * 2 + 1), "rect", _rect(F.col("c.x") - half, F.col("c.y") - half, F.col("c.x") - half + view.bullet, F.col("c.y") - half + view.bullet), F.lit(style.landmark_bullet))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def display_list(back: DataFrame | None, areas: DataFrame, landmarks: DataFrame, view: Viewport, style: Style, modes: tuple[str, ...]) -> DataFrame:
    """All commands of a tile. Without a backdrop the areas are drawn all the same."""
    out = area_pictures(areas, landmarks, view, style, modes)
    if back is not None:
        layer = 4 if style.water_in_front else 1
        shown = back.crossJoin(_counted(modes_of(areas, modes)))
        out = out.unionByName(shown.withColumn("z", F.lit(layer * _STEP) + F.shiftright("z", 32) * F.lit(1 << 30) + F.pmod(F.col("z"), F.lit(1 << 30))).select(*out.columns))
    return out.select(F.lit(view.width).alias("tile"), "mode", F.col("active").alias("area_idx"), *COLUMNS[3:])


def differences(pictures: DataFrame) -> DataFrame:
    """The commands of each picture that the base picture of its tile does not have."""
    what = ["tile", *COLUMNS[3:]]
    flat = pictures.withColumn("_p", F.to_json("points"))
    base = flat.where(F.col("mode") == "BASE").select("tile", *COLUMNS[3:-1], "_p").distinct()
    others = flat.where(F.col("mode") != "BASE")
    same = [others[c].eqNullSafe(base[c]) for c in [*what[:-1], "_p"]]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return others.join(base, condition, "left_anti").drop("_p")
