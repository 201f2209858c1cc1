"""Results kept by key: Parquet folders named by a digest of everything the result depends on."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mapframe.schema import Style, Viewport

#: Part of every key: raise it when the meaning of what is kept changes.
VERSION = 2


def backdrop_key(view: Viewport, style: Style, inputs: list[str] | None = None, rule: str = "") -> str:
    """SHA-256 of the box, the size, the colour of water, whether water is in front, the inputs (by their fingerprints) and the tag rule."""
    b = view.box
    data = struct.pack("=4d2iI", b.lat_min, b.lon_min, b.lat_max, b.lon_max, view.width, view.height, style.water)
    data += b"\x01" if style.water_in_front else b""
    if inputs is not None or rule:
        data += repr((VERSION, sorted(inputs or []), rule)).encode()
    return hashlib.sha256(data).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a result was written to its end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cached(spark: SparkSession, folder: str | None, key: str, build: Callable[[], DataFrame | None] | None, use: bool = True, keep: bool = True) -> DataFrame | None:
    """What is kept under the key; else what ``build`` makes, which is kept. Without ``build`` only a look."""
    path = f"{folder}/{key}" if folder else None
    if path and use and exists(spark, path):
        return spark.read.parquet(path)
    made = build() if build else None
    if made is None or not path or not keep:
        return made
    made.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
