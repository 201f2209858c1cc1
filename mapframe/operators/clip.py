"""Clipping polylines to a rectangle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapframe.functions.geo import num, point


def segments(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive vertices of each path: ``keys, seg, ax, ay, bx, by``."""
    pairs = F.zip_with(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(1))), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    pairs = F.when(F.size("points") > 1, pairs)
    return paths.select(*keys, F.posexplode(pairs).alias("seg", "s")).select(*keys, "seg", "s.*")


def cut(ax: Column, ay: Column, bx: Column, by: Column, width: float, height: float) -> tuple[Column, Column]:
    """The parameters of a segment between which it is in ``(0, 0, width, height)``; the first is larger if it is not."""
    low, high = num(0), num(1)
    for a, d, bound in ((ax, bx - ax, width), (ay, by - ay, height)):
        near, far = (0 - a) / d, (num(bound) - a) / d
        outside = (a < 0) | (a > num(bound))
        low = F.greatest(low, F.when(d == 0, F.when(outside, num(2)).otherwise(num(0))).otherwise(F.least(near, far)))
        high = F.least(high, F.when(d == 0, num(1)).otherwise(F.greatest(near, far)))
    return low, high


def _snapped(start: Column, along: Column, t: Column, bound: float, hit_low: Column, hit_high: Column) -> Column:
    """A coordinate at ``t``: exactly on a bound where that bound made the cut, never beyond one."""
    return F.when(hit_low, num(0)).when(hit_high, num(bound)).otherwise(F.least(F.greatest(start + t * along, num(0)), num(bound)))


def clip(paths: DataFrame, width: float, height: float, keys: list[str]) -> DataFrame:
    """``keys, sub, points``: the parts of each path within ``(0, 0, width, height)``, in order.

    End points that a bound made are the bound itself, so that they can be compared exactly later. A path that only
    touches the rectangle in a point has no part.
    """
    found = segments(paths, keys)
    low, high = cut(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), width, height)
    found = found.withColumns({"t0": low, "t1": high}).where("t0 < t1")

    def at(t: Column, original: Column, x: Column, y: Column) -> Column:
        dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
        on = lambda a, d, bound: F.coalesce((bound - a) / F.when(d != 0, d) == t, F.lit(False))
        ax, ay = F.col("ax"), F.col("ay")
        moved = point(_snapped(ax, dx, t, width, on(ax, dx, num(0)), on(ax, dx, num(width))), _snapped(ay, dy, t, height, on(ay, dy, num(0)), on(ay, dy, num(height))))
        return F.when(original, point(x, y)).otherwise(moved)

    found = found.withColumns({"a": at(F.col("t0"), F.col("t0") == 0, F.col("ax"), F.col("ay")), "b": at(F.col("t1"), F.col("t1") == 1, F.col("bx"), F.col("by"))})
    order = Window.partitionBy(*keys).orderBy("seg")
    goes_on = (F.lag("seg").over(order) == F.col("seg") - 1) & (F.lag("t1").over(order) == 1) & (F.col("t0") == 0)
    found = found.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    found = found.withColumn("sub", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = found.groupBy(*keys, "sub").agg(F.array_sort(F.collect_list(F.struct("seg", "a", "b"))).alias("s"))
    return parts.select(*keys, "sub", F.concat(F.array(F.element_at("s", 1)["a"]), F.transform("s", lambda s: s["b"])).alias("points"))
