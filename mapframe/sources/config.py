"""City configuration: a JSON object with the box, the areas and the landmarks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapframe.functions.geo import num, point
from mapframe.schema import Box

_TEXT = "areaBox array<string>, areas array<struct<polygon:string,label:string,center:array<string>,type:string>>, landmarks array<struct<display:string,lat:string,lon:string,label:string>>"


@dataclass(frozen=True)
class Config:
    box: Box
    areas: DataFrame  # idx, name, type, center, points (degrees)
    landmarks: DataFrame  # idx, display, lon, lat, label


def as_number(text: Column) -> Column:
    """The number at the start of a JSON value; 0 where there is none."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double"), num(0))


def as_flag(text: Column) -> Column:
    """True for true, for a number that is not 0, and for text that starts with Y, T or a digit from 1 to 9."""
    return F.coalesce((as_number(text) != 0) | text.rlike(r"^\s*[-+]?0*[YyTt1-9]"), F.lit(False))


def parse_polygon(text: Column, strict: bool = True) -> Column:
    """Points from ``"lat lon,lat lon,..."``. A vertex that can't be read is an error, or if not ``strict`` repeats the
    one before it."""
    figure = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
    part = lambda v, n: F.regexp_extract(v, rf"^\s*({figure})\s+({figure})", n).try_cast("double")
    read = F.transform(F.split(text, ","), lambda v: point(part(v, 2), part(v, 1)))
    bad = F.exists(read, lambda p: p["x"].isNull() | p["y"].isNull())
    if strict:
        return F.when(bad, F.raise_error(F.concat(F.lit("a vertex of a polygon can't be read: "), text)).cast("array<struct<x:double,y:double>>")).otherwise(read)
    empty = F.slice(read, 1, 0)
    return F.when(bad, F.aggregate(read, empty, lambda acc, p: F.concat(acc, F.array(F.when(p["x"].isNull() | p["y"].isNull(), F.try_element_at(acc, F.lit(-1))).otherwise(p))))).otherwise(read)


def load_config(spark: SparkSession, path: str, strict: bool = True) -> Config:
    """Read and check a configuration; malformed JSON and a box of other than four numbers are errors."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.from_json("value", _TEXT, {"mode": "FAILFAST"}).alias("c")).select("c.*")
    try:
        rows = parsed.select(F.transform("areaBox", as_number).alias("b")).collect()
    except Exception as error:
        raise ValueError(f"{path} can't be parsed: {str(error).splitlines()[0]}") from error
    if not spark.read.text(path, wholetext=True).first().value.lstrip().startswith("{"):
        raise ValueError(f"{path} does not contain an object at the root level")
    box = rows[0].b if rows else None
    if box is None:
        raise ValueError(f"{path} is missing an areaBox")
    if len(box) != 4:
        raise ValueError(f"{path}: areaBox is not exactly 4 elements")
    area = parsed.select(F.posexplode("areas").alias("idx", "a")).select("idx", "a.*")
    wrong = F.raise_error(F.format_string(f"{path}: the center of area \"%s\" is not 2 elements", "label")).cast("array<string>")
    area = area.withColumn("center", F.when(F.size("center") == 2, F.col("center")).otherwise(wrong))
    areas = area.select("idx", F.col("label").alias("name"), as_number(F.col("type")).cast("int").alias("type"), point(as_number(F.col("center")[1]), as_number(F.col("center")[0])).alias("center"), parse_polygon(F.col("polygon"), strict).alias("points"))
    marks = parsed.select(F.posexplode("landmarks").alias("idx", "m")).select("idx", as_flag(F.col("m.display")).alias("display"), as_number(F.col("m.lon")).alias("lon"), as_number(F.col("m.lat")).alias("lat"), F.col("m.label").alias("label"))
    return Config(Box(*box), areas, marks)
