"""A city's pictures, from its configuration and map files to the display list."""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapframe.functions.style import callout_name
from mapframe.functions.tags import render_filter
from mapframe.operators.cache import backdrop_key, cached
from mapframe.operators import raster
from mapframe.operators.display import COLUMNS, backdrop, differences, display_list
from mapframe.operators.ways import ways_in_rect
from mapframe.schema import Box, RunOptions, Viewport
from mapframe.sources.config import Config, load_config
from mapframe.sources.files import covering_files, fingerprint
from mapframe.sources.pbf import open_path, read_pbf

log = logging.getLogger("mapframe")


def ways_of_file(spark: SparkSession, path: str, box: Box, strict: bool = True, held: list[DataFrame] | None = None) -> DataFrame:
    nodes, ways, relations = (read_pbf(spark, path, e, strict=strict) for e in ("nodes", "ways", "relations"))
    inside = read_pbf(spark, path, "nodes", box=",".join(map(str, box.nano)))
    return ways_in_rect(nodes, ways, relations, box, render_filter, strict, inside, held)


def first_with_rows(spark: SparkSession, files: list[str], options: RunOptions, box: Box) -> DataFrame | None:
    """The ways of the first file that has any; the result is kept, since both sizes of picture use it."""
    for path in files:
        if options.dummy_run:
            return _no_ways(spark)
        log.info("looking for ways in %s", path)
        held: list[DataFrame] = []
        found = ways_of_file(spark, path, box, options.strict, held).persist()
        count = found.count()
        for part in held:
            part.unpersist()
        log.info("%d ways", count)
        if count:
            return found
        found.unpersist()
    return None


def _no_ways(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "path string, way_id long, tags map<string,string>, points array<struct<x:double,y:double>>")


def render_city(spark: SparkSession, options: RunOptions, config: Config | None = None) -> dict[str, DataFrame]:
    """``pictures``: the base, hover and active pictures; ``atlas``: the base picture and what each hover and active picture changes; ``callouts``: small pictures, with the
    name of the file each belongs to."""
    config = config or load_config(spark, options.config, options.strict)
    view, style = Viewport(config.box, options.size, options.size), options.style
    state: dict = {}

    def ways() -> DataFrame | None:
        if "ways" not in state:
            files = [options.map_file] if options.map_file else covering_files(spark, options.map_directory, config.box)
            log.info("map files: %s", files)
            state["ways"] = first_with_rows(spark, files, options, config.box)
            if state["ways"] is None:
                log.warning("no map file covers the box and has ways: the pictures have no backdrop")
        return state["ways"]

    def back(v: Viewport) -> DataFrame | None:
        key = backdrop_key(v, style, fingerprint([options.map_file or options.map_directory]), "render_filter")
        build = lambda: backdrop(w, v, style) if (w := ways()) is not None else None
        return cached(spark, options.cache_dir, key, build, not options.no_cache, not options.dummy_run)

    large = display_list(back(view), config.areas, config.landmarks, view, style, ("BASE", "HOVER", "ACTIVE"))
    atlas = large.where(F.col("mode") == "BASE").unionByName(differences(large))
    small = view.callout()
    callouts = display_list(back(small), config.areas, config.landmarks, small, style, ("CALLOUT",))
    return {"pictures": large, "atlas": atlas, "callouts": callouts.withColumn("file", callout_name(options.prefix, F.col("area_idx")))}


def write_city(spark: SparkSession, options: RunOptions) -> None:
    """Write both tables as Parquet beside ``prefix`` and draw them: ``<prefix>.png``, an atlas of the base picture and of
    what each other picture changes in it, and a small picture for each area. A city has few pictures of a fixed size."""
    made = render_city(spark, options)
    made["atlas"].write.mode("overwrite").parquet(f"{options.prefix}-atlas.parquet")
    made["callouts"].write.mode("overwrite").partitionBy("area_idx").parquet(f"{options.prefix}-callouts.parquet")
    icon = _icon(options.icon)
    full = made["pictures"].select("mode", "area_idx", *COLUMNS[3:], "tile")
    shots = {(r.mode, r.area_idx): _pixels(r) for r in raster.pictures(full, ["mode", "area_idx"], icon).toLocalIterator()}
    base = shots.pop(("BASE", -1))
    order = sorted(shots, key=lambda k: (k[1], k[0] == "ACTIVE"))
    images = [base, *(raster.trimmed(raster.changed(shots[k], base)) for k in order)]
    _save(f"{options.prefix}.png", raster.png(raster.atlas(images)))
    for r in raster.pictures(made["callouts"].drop("area_idx"), ["file"], icon).toLocalIterator():
        _save(r.file, raster.png(_pixels(r)))


def _icon(path: str | None) -> np.ndarray:
    if path is None:
        return raster.tree()
    fs, at = open_path(path)
    with fs.open_input_stream(at) as file:
        return raster.read_png(file.read())


def _pixels(row) -> np.ndarray:
    return np.frombuffer(row.rgba, np.uint8).reshape(row.height, row.width, 4)


def _save(path: str, data: bytes) -> None:
    fs, at = open_path(path)
    with fs.open_output_stream(at) as out:
        out.write(data)
