"""Coordinates as columns: degrees, nanodegrees, pixels, the edge of a rectangle, label boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapframe.schema import Box, Viewport


def num(x: float) -> Column:
    return F.lit(float(x))


def deg_to_nano(degrees: Column) -> Column:
    """Nanodegrees, truncated toward zero."""
    return (degrees * num(1e9)).cast("long")


def nano_to_deg(nano: Column) -> Column:
    return nano * num(1e-9)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def in_box(lat_nano: Column, lon_nano: Column, box: Box) -> Column:
    """Whether a node lies in the box, its four edges included; compared as integers, so it can be pushed down."""
    lat_min, lon_min, lat_max, lon_max = box.nano
    return lat_nano.between(lat_min, lat_max) & lon_nano.between(lon_min, lon_max)


def each(points: Column, x: Callable[[Column], Column], y: Callable[[Column], Column]) -> Column:
    return F.transform(points, lambda p: point(x(p["x"]), y(p["y"])))


def translate(points: Column, view: Viewport) -> Column:
    """Relative to the upper left corner of the box, in degrees."""
    return each(points, lambda x: x - num(view.box.lon_min), lambda y: y - num(view.box.lat_max))


def scale(points: Column, view: Viewport) -> Column:
    sx, sy = view.scale
    return each(points, lambda x: x * num(sx), lambda y: y * num(sy))


def to_pixel(lon: Column, lat: Column, view: Viewport) -> Column:
    """The nearest pixel, halves away from zero."""
    b = view.box
    x = F.round((lon - num(b.lon_min)) * num(view.width) / num(b.lon_max - b.lon_min))
    y = F.round((lat - num(b.lat_max)) * num(view.height) / num(b.lat_min - b.lat_max))
    return point(x, y)


def contains(outer: tuple[Column, ...], inner: tuple[Column, ...]) -> Column:
    """Whether a rectangle ``(x_min, y_min, x_max, y_max)`` holds another one; edges may touch, empty ones hold nothing."""
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3]) & (outer[0] < outer[2]) & (outer[1] < outer[3]) & (inner[0] < inner[2]) & (inner[1] < inner[3])


def edge_id(x: Column, y: Column, width: float, height: float) -> Column:
    """The edge of ``(0, 0, width, height)`` that a point is on, by exact equality: 0 top, 1 right, 2 bottom, else 3."""
    return F.when(y == 0, 0).when(x == num(width), 1).when(y == num(height), 2).otherwise(3)


def perimeter_pos(x: Column, y: Column, width: float, height: float) -> Column:
    """How far along the edge of ``(0, 0, width, height)`` a point is, clockwise from the upper left corner."""
    w, h = num(width), num(height)
    off = F.raise_error(F.format_string("(%s, %s) is not on the edge", x.cast("string"), y.cast("string"))).cast("double")
    return F.when(y == 0, x).when(x == w, w + y).when(y == h, w + h + w - x).when(x == 0, w + h + w + h - y).otherwise(off)


def corners_between(start: Column, end: Column, width: float, height: float) -> Column:
    """The corners passed clockwise from one edge to another; none if both are the same."""
    corners = F.array(*(point(num(x), num(y)) for x, y in ((width, 0), (width, height), (0, height), (0, 0))))
    steps = F.pmod(end - start, F.lit(4))
    order = F.transform(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), lambda k: F.element_at(corners, F.pmod(start + k, F.lit(4)) + 1))
    return F.when(steps == 0, F.slice(order, 1, 0)).otherwise(order)


def corners_ahead(begin: Column, end: Column, width: float, height: float) -> Column:
    """The corners passed clockwise from one place along the edge to another; all four if both are the same."""
    full = 2 * (width + height)
    ahead = lambda d: F.when(F.pmod(d, num(full)) == 0, num(full)).otherwise(F.pmod(d, num(full)))
    stops = ((width, 0, width), (width, height, width + height), (0, height, 2 * width + height), (0, 0, 0))
    far = F.array(*(F.struct(ahead(num(place) - begin).alias("d"), point(num(x), num(y)).alias("p")) for x, y, place in stops))
    return F.transform(F.filter(F.array_sort(far), lambda s: s["d"] < ahead(end - begin)), lambda s: s["p"])


def label_box(cx: Column, cy: Column, w: Column, h: Column, view: Viewport, margin: int = 2) -> Column:
    """A label of size (w, h) centred on a point, moved inside the picture (the far sides win), on whole pixels."""
    x0, y0 = F.greatest(cx - w * 0.5, num(margin)), F.greatest(cy - h * 0.5, num(margin))
    x0 = F.when(x0 + w > view.width - margin, view.width - w - margin).otherwise(x0)
    y0 = F.when(y0 + h > view.height - margin, view.height - h - margin).otherwise(y0)
    left, top = F.floor(x0).cast("double"), F.floor(y0).cast("double")
    return F.struct(left.alias("x"), top.alias("y"), (F.ceil(x0 + w) - left).alias("w"), (F.ceil(y0 + h) - top).alias("h"))


def inset(rect: Column, by: float) -> Column:
    return F.struct((rect["x"] + by).alias("x"), (rect["y"] + by).alias("y"), (rect["w"] - 2 * by).alias("w"), (rect["h"] - 2 * by).alias("h"))


def text_extent(text: Column, font_size: int) -> tuple[Column, Column]:
    """An estimate of a label's size from its longest line and its lines; a renderer with fonts would replace it."""
    lines = F.split(text, "\n")
    return F.ceil(F.array_max(F.transform(lines, F.length)) * font_size * 0.6).cast("double"), (F.size(lines) * font_size).cast("double")


def is_closed(points: Column) -> Column:
    return (F.size(points) > 0) & (F.element_at(points, 1) == F.element_at(points, -1))


def closed(points: Column) -> Column:
    """``points``, ending where they begin."""
    return F.when(is_closed(points) | (F.size(points) == 0), points).otherwise(F.concat(points, F.slice(points, 1, 1)))


def strictly_inside(p: Column, width: float, height: float) -> Column:
    return (p["x"] > 0) & (p["y"] > 0) & (p["x"] < num(width)) & (p["y"] < num(height))
