"""Which map files can answer a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapframe.functions.geo import contains, nano_to_deg, num
from mapframe.schema import Box
from mapframe.sources.pbf import SUFFIX, listed, open_path, read_pbf


def is_map_file(name: Column) -> Column:
    """By the last eight characters, case-sensitive."""
    return name.endswith(SUFFIX)


def headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a file, from its first block; a file whose first block is another has none."""
    return read_pbf(spark, paths, "header")


def covering(heads: DataFrame, box: Box) -> DataFrame:
    """Headers whose box holds the query's; a file without a box covers nothing."""
    outer = tuple(nano_to_deg(F.col(f"{s}_nano")) for s in ("left", "bottom", "right", "top"))
    inner = (num(box.lon_min), num(box.lat_min), num(box.lon_max), num(box.lat_max))
    return heads.where(F.coalesce(contains(outer, inner), F.lit(False)))


def fingerprint(paths: list[str]) -> list[str]:
    """Name, size and time of change of the files of each path: what a kept result depends on beside its settings."""
    out = []
    for path in (file for p in paths for file in listed(p)):
        system, at = open_path(path)
        info = system.get_file_info(at)
        out.append(f"{path}:{info.size}:{info.mtime_ns}")
    return sorted(out)


def covering_files(spark: SparkSession, directory: str, box: Box) -> list[str]:
    """Paths of the map files of a directory that cover the box, by name: a short list, one entry a file."""
    return [r.path for r in covering(headers(spark, directory), box).where(is_map_file(F.col("path"))).orderBy("path").select("path").collect()]
