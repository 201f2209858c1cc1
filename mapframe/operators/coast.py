"""Closed coast lines from the parts that a rectangle leaves of them.

Which part follows which is decided from the ends of the parts alone: points, and places along the edge of the rectangle.
They are few numbers a part; a tile's go to one function, ordered by way and part, which finds every successor by a look
into a table of starts or by binary search among the places of starts. Points stay in the engine, and each ring is put
together there from its parts and the corners between them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapframe.functions import geo

Point = tuple[float, float]
_PART = ["path", "way_id", "sub"]
_LINKS = "ring int, place int, walk boolean, closing boolean, nx double, ny double, nway double"


def dangles(points: Column, width: float, height: float) -> Column:
    """Whether an open path begins or ends strictly inside the rectangle."""
    ends = (F.element_at(points, 1), F.element_at(points, -1))
    return ~geo.is_closed(points) & (geo.strictly_inside(ends[0], width, height) | geo.strictly_inside(ends[1], width, height))


class Starts:
    """Parts by the point they start at, each list in the order of the parts."""

    def __init__(self, starts: list[Point], ends: list[Point]):
        self.at: dict[Point, list[int]] = defaultdict(list)
        for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
            if a != b:
                self.at[a].append(k)

    def take(self, point: Point, behind: int, but: int) -> int | None:
        """The first part behind ``behind`` that starts at the point and is not ``but``; beyond the last, the first of all."""
        here = self.at.get(point, [])
        first = bisect_right(here, behind)
        for step in range(min(2, len(here))):
            if here[k := (first + step) % len(here)] != but:
                return here.pop(k)
        return None


def chains(starts: list[Point], ends: list[Point]) -> dict[int, list[int]]:
    """Parts that meet end to start, as lists by their first part. A part that closes itself is a list of its own."""
    waiting, out, used = Starts(starts, ends), {}, set()
    for k, start in enumerate(starts):
        if k in used:
            continue
        out[k], behind = [k], -1
        while start != ends[k] and (after := waiting.take(ends[out[k][-1]], behind, k)) is not None:
            used.add(after)
            out[k] += out.pop(after, [after])
            behind = after
        if start == ends[out[k][-1]] and k in (here := waiting.at[start]):
            here.remove(k)
    return out


def linked(starts: list[Point], ends: list[Point], way_in: list[float | None], way_out: list[float | None]) -> list[tuple[list[int], set[int]]]:
    """Rings: the parts of each in order, and those among them behind which the edge is walked to the next.

    ``way_in`` and ``way_out`` are the places of the ends along the edge, None where one lies inside. Chains with such an
    end are left out. The others go on, clockwise along the edge, at the nearest start, their own included; of starts at
    one place the first part's counts.
    """
    found = chains(starts, ends)
    closed = {k for k, c in found.items() if starts[k] == ends[c[-1]]}
    kept = {k: c for k, c in found.items() if k in closed or (way_in[k] is not None and way_out[c[-1]] is not None)}
    places = sorted((way_in[k], k) for k in kept if k not in closed)
    walks: dict[int, set[int]] = {k: set() for k in kept}
    for k in [k for k in kept if k not in closed]:
        while k in kept:
            at = bisect_left(places, (way_out[kept[k][-1]], -1)) % len(places)
            _, after = places.pop(at)
            walks[k].add(kept[k][-1])
            if after == k:
                break
            kept[k] += kept.pop(after)
    return [(c, walks[k]) for k, c in kept.items()]


def coast_rings(parts: DataFrame, width: float, height: float, keys: list[str], correct: bool = False) -> DataFrame:
    """``keys, ring, points`` from ``keys, path, way_id, sub, points``; the parts lie in ``(0, 0, width, height)``.

    Between two parts on different edges the corners on the way are put, unless the points share a coordinate and the start
    lies ahead. With ``correct`` every corner that the walk passes is put, also where it goes around to the same edge.
    """
    size = (width, height)
    a, b = F.element_at("points", 1), F.element_at("points", -1)
    way = lambda p: F.when(~geo.is_closed(F.col("points")) & ~geo.strictly_inside(p, *size), geo.perimeter_pos(p["x"], p["y"], *size))
    parts = parts.where(F.size("points") > 0)
    ends = parts.select(*keys, *_PART, a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"), way(a).alias("way_in"), way(b).alias("way_out"))

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(_PART).reset_index(drop=True)
        starts, stops = (list(zip(frame[x].tolist(), frame[y].tolist(), strict=True)) for x, y in (("x0", "y0"), ("x1", "y1")))
        ways = [[None if pd.isna(w) else w for w in frame[c].tolist()] for c in ("way_in", "way_out")]
        rows = []
        for ring, (order, walks) in enumerate(linked(starts, stops, *ways)):
            for place, (k, after) in enumerate(zip(order, [*order[1:], order[0]], strict=True)):
                rows.append((k, ring, place, k in walks, place + 1 == len(order), *starts[after], ways[0][after]))
        found = pd.DataFrame(rows, columns=["k", *(x.split()[0] for x in _LINKS.split(", "))])
        return pd.concat([frame.loc[found.pop("k"), [*keys, *_PART]].reset_index(drop=True), found.astype({"nway": float})], axis=1)

    schema = ", ".join([*(f"`{k}` {t}" for k, t in ends.select(*keys, *_PART).dtypes), _LINKS])
    links = ends.groupBy(*keys).applyInPandas(link, schema)
    rows = parts.select(*keys, *_PART, "points").join(links, [*keys, *_PART])
    end, after = F.element_at("points", -1), F.struct(F.col("nx").alias("x"), F.col("ny").alias("y"))
    out = geo.perimeter_pos(end["x"], end["y"], *size)
    if correct:
        corners = geo.corners_ahead(out, F.col("nway"), *size)
    else:
        between = geo.corners_between(geo.edge_id(end["x"], end["y"], *size), geo.edge_id(F.col("nx"), F.col("ny"), *size), *size)
        apart = (end["x"] != F.col("nx")) & (end["y"] != F.col("ny"))
        corners = F.when(apart | (out >= F.col("nway")), between).otherwise(F.slice("points", 1, 0))
    walked = F.when(F.col("walk"), F.concat("points", corners)).otherwise(F.col("points"))
    # A point that two parts share is kept once; a ring that was closed along the edge ends with its first point.
    rows = rows.withColumn("walked", walked).withColumn("piece", F.when(F.col("closing"), F.when(F.col("walk"), F.concat("walked", F.array(after))).otherwise(F.col("walked"))).when(F.element_at("walked", -1) == after, F.slice(F.col("walked"), F.lit(1), F.size("walked") - 1)).otherwise(F.col("walked")))
    made = rows.groupBy(*keys, "ring").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("p"))
    return made.select(*keys, "ring", F.flatten(F.transform("p", lambda p: p["piece"])).alias("points"))
