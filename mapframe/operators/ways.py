"""Ways that touch a rectangle, with their whole geometry and the tags of their relations.

All joins are on the file and the id, since ids are only unique within a file. The tag filter comes first and both sides
of the semi-join are derived from what it lets through: ways that are thrown away never meet a node. The box is a
comparison of integers, which reaches the scan of the nodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapframe.functions.geo import in_box, nano_to_deg
from mapframe.schema import Box

Predicate = Callable[[Column], Column]


def matching(ways: DataFrame, where: Predicate | None) -> DataFrame:
    """Ways whose own tags satisfy the predicate; without one, all."""
    return ways if where is None else ways.where(F.coalesce(where(F.col("tags")), F.lit(False)))


def way_refs(ways: DataFrame) -> DataFrame:
    """One row a reference, with its place; empty ways have none."""
    return ways.select("path", "way_id", "file_ordinal", F.posexplode("refs").alias("pos", "node_id"))


def ways_touching(refs: DataFrame, nodes: DataFrame, box: Box) -> DataFrame:
    """``path, way_id`` of ways with a vertex in the box. One that only crosses it is not among them."""
    inside = nodes.where(in_box(F.col("lat_nano"), F.col("lon_nano"), box)).select("path", "node_id")
    return refs.join(inside, ["path", "node_id"], "left_semi").select("path", "way_id").distinct()


def last_wins(rows: DataFrame, keys: list[str], order: str = "file_ordinal") -> DataFrame:
    """Of rows with equal keys the one that stands last."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def assemble_paths(refs: DataFrame, nodes: DataFrame, strict: bool = True) -> DataFrame:
    """``path, way_id, points`` (degrees, in the order of the references, repeats kept). A node that is missing is an
    error, or if not ``strict`` leaves its vertex out; of nodes with equal ids the last one counts."""
    at = nodes.select("path", "node_id", F.col("file_ordinal").alias("node_order"), "lat_nano", "lon_nano")
    placed = refs.join(at, ["path", "node_id"], "left")
    vertex = F.struct("pos", "node_order", nano_to_deg(F.col("lon_nano")).alias("x"), nano_to_deg(F.col("lat_nano")).alias("y"))
    rows = placed.groupBy("path", "way_id").agg(F.array_sort(F.collect_list(vertex)).alias("v"))
    last = F.filter("v", lambda p, i: (i == F.size("v") - 1) | (F.try_element_at(F.col("v"), i + 2)["pos"] != p["pos"]))
    missing = F.exists("v", lambda p: p["x"].isNull())
    points = F.transform(F.filter(last, lambda p: p["x"].isNotNull()), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    if strict:
        failed = F.raise_error(F.format_string("way %d refers to a node that is not in its file", "way_id")).cast("array<struct<x:double,y:double>>")
        points = F.when(missing, failed).otherwise(points)
    return rows.select("path", "way_id", points.alias("points"))


def overlay_relations(ways: DataFrame, relations: DataFrame) -> DataFrame:
    """``ways`` with the tags of the relations that have them as members, the later ones over the earlier and all over
    the ways' own. Only way members count, and only relations of the same file."""
    member = relations.select("path", "file_ordinal", "tags", F.explode("members").alias("m")).where(F.col("m.type") == "WAY")
    member = member.select("path", F.col("m.ref").alias("way_id"), F.col("file_ordinal").alias("ord"), "tags")
    lent = member.join(ways.select("path", "way_id"), ["path", "way_id"], "left_semi").select("path", "way_id", "ord", F.explode(F.map_entries("tags")).alias("e"))
    latest = lent.groupBy("path", "way_id", F.col("e.key").alias("key")).agg(F.max_by("e.value", "ord").alias("value"))
    maps = latest.groupBy("path", "way_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("lent"))
    own = F.map_filter("tags", lambda k, _: ~F.map_contains_key("lent", k))
    return ways.join(maps, ["path", "way_id"], "left").withColumn("tags", F.coalesce(F.map_concat(own, F.col("lent")), "lent", "tags")).drop("lent")


#: References whose nodes are picked by a broadcast of their ids.
MOST_REFS = 200_000


def nodes_of(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` without those that no reference names, if the references are counted to be few: such nodes then never
    leave the task that reads them. Otherwise all ``nodes``, which the join shuffles."""
    if refs.limit(MOST_REFS + 1).count() > MOST_REFS:
        return nodes
    return nodes.join(F.broadcast(refs.select("path", "node_id").distinct()), ["path", "node_id"], "left_semi")


def ways_in_rect(nodes: DataFrame, ways: DataFrame, relations: DataFrame | None, box: Box, where: Predicate | None = None, strict: bool = True, inside: DataFrame | None = None, held: list[DataFrame] | None = None) -> DataFrame:
    """``path, way_id, tags, points`` of the ways that satisfy ``where`` and have a vertex in the box.

    ``inside`` are the nodes to look for the box in, where a source can read those apart from the rest. With a list
    ``held`` the chosen ways are kept in the session's cache and added to it, for the caller to let them
    go once the result is used, and nodes are reduced by :func:`nodes_of`; without one nothing runs or stays.
    """
    keep = (lambda df: held.append(df.persist()) or df) if held is not None else (lambda df: df)
    wanted = matching(ways, where)
    hit = ways_touching(way_refs(wanted), nodes if inside is None else inside, box)
    kept = keep(last_wins(wanted.join(hit, ["path", "way_id"], "left_semi"), ["path", "way_id"]))
    refs = way_refs(kept)
    paths = assemble_paths(refs, nodes if held is None else nodes_of(refs, nodes), strict)
    out = kept.select("path", "way_id", "tags")
    out = out if relations is None else overlay_relations(out, relations)
    return out.join(paths, ["path", "way_id"])
