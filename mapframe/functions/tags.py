"""Predicates on the tags of a way. A missing tag is no match, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as water, by key. "reservoid" is spelled so in the rules that results must agree with.
WATER = {
    "natural": ("lake", "pond", "water"),
    "landuse": ("basin", "lake", "pond", "reservoid", "water"),
    "waterway": ("dock", "riverbank"),
}


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def has_tag(tags: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(tags, key), F.lit(False))


def tag_is(tags: Column, key: str, *values: str) -> Column:
    return F.coalesce(tag(tags, key).isin(*values), F.lit(False))


def is_water(tags: Column, reservoirs: bool = False) -> Column:
    """Whether a way is standing or harbour water; with ``reservoirs`` also ``landuse=reservoir``."""
    found = F.lit(False)
    for key, values in WATER.items():
        found = found | tag_is(tags, key, *values, *(("reservoir",) if reservoirs and key == "landuse" else ()))
    return found


def is_bridge(tags: Column) -> Column:
    """Any value counts, ``no`` included."""
    return has_tag(tags, "bridge")


def is_coast(tags: Column) -> Column:
    return tag_is(tags, "natural", "coastline")


def render_filter(tags: Column) -> Column:
    """Ways that a map shows."""
    return is_bridge(tags) | is_coast(tags) | is_water(tags)


def kind(tags: Column) -> Column:
    """``bridge`` before ``coast``; water is a flag of its own, since a way may be both."""
    return F.when(is_bridge(tags), "bridge").when(is_coast(tags), "coast")
