"""Types of the map tables, and the small settings that queries take as literals."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POINTS = T.ArrayType(POINT)
TAGS = T.MapType(T.StringType(), T.StringType(), False)
MEMBER = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("ref", T.LongType())])

_FILE = [T.StructField("path", T.StringType()), T.StructField("file_ordinal", T.LongType())]
HEADERS = T.StructType([_FILE[0], *(T.StructField(f"{s}_nano", T.LongType()) for s in ("left", "right", "top", "bottom")), T.StructField("required_features", T.ArrayType(T.StringType())), T.StructField("optional_features", T.ArrayType(T.StringType())), T.StructField("program", T.StringType()), T.StructField("source", T.StringType())])
NODES = T.StructType([*_FILE, T.StructField("node_id", T.LongType()), T.StructField("lat_nano", T.LongType()), T.StructField("lon_nano", T.LongType())])
WAYS = T.StructType([*_FILE, T.StructField("way_id", T.LongType()), T.StructField("tags", TAGS), T.StructField("refs", T.ArrayType(T.LongType()))])
RELATIONS = T.StructType([*_FILE, T.StructField("rel_id", T.LongType()), T.StructField("tags", TAGS), T.StructField("members", T.ArrayType(MEMBER))])
BLOBS = T.StructType([_FILE[0], T.StructField("idx", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("type", T.StringType()), T.StructField("datasize", T.LongType()), T.StructField("codec", T.StringType())])
ENTITIES = {"header": HEADERS, "nodes": NODES, "ways": WAYS, "relations": RELATIONS, "blobs": BLOBS}


@dataclass(frozen=True)
class Box:
    """A rectangle in degrees; corners may be given in any order. A box across the antimeridian is not expressible."""

    lat_min: float
    lon_min: float
    lat_max: float
    lon_max: float

    def __post_init__(self):
        for low, high in (("lat_min", "lat_max"), ("lon_min", "lon_max")):
            a, b = getattr(self, low), getattr(self, high)
            object.__setattr__(self, low, min(a, b))
            object.__setattr__(self, high, max(a, b))

    @property
    def nano(self) -> tuple[int, int, int, int]:
        """``(lat_min, lon_min, lat_max, lon_max)`` in nanodegrees, truncated toward zero."""
        return tuple(int(x * 1e9) for x in (self.lat_min, self.lon_min, self.lat_max, self.lon_max))


@dataclass(frozen=True)
class Viewport:
    """A box and the size of the picture it is drawn to, with what depends on that size."""

    box: Box
    width: int = 396
    height: int = 396
    font_size: int = 11
    bullet: int = 6

    @property
    def scale(self) -> tuple[float, float]:
        """Pixels for a degree, from the upper left corner; y grows downward."""
        return self.width / (self.box.lon_max - self.box.lon_min), self.height / (self.box.lat_min - self.box.lat_max)

    def callout(self) -> Viewport:
        return replace(self, width=290, height=290, font_size=10, bullet=5)


def color_mean(a: int, b: int) -> int:
    """The mean of two colours, channel by channel, of their upper seven bits."""
    return ((a >> 1) & 0x7F7F7F7F) + ((b >> 1) & 0x7F7F7F7F)


@dataclass(frozen=True)
class Style:
    """Colours (ARGB) and switches. The defaults are fixed values."""

    land: int = 0xFFF6F5F2
    park: int = 0xFFE2EED4
    inactive_area: int = 0xFFDEE9F1
    active_area: int = 0xFFFEC801
    hover_area: int = color_mean(0xFFAEC6E1, 0xFFDEE9F1)
    hover_park: int = color_mean(0xFFAEC6E1, 0xFFE2EED4)
    water: int = 0xFFA1C5ED
    inactive_label: int = 0xFF4C4C4C
    active_label: int = 0xFFFFFFFF
    active_label_background: int = 0x7F000000
    landmark_label: int = 0xFF7C126A
    landmark_bullet: int = 0xFF7C126A
    water_in_front: bool = True


@dataclass(frozen=True)
class RunOptions:
    config: str
    map_directory: str = "."
    map_file: str | None = None
    prefix: str = "output"
    size: int = 396
    style: Style = field(default_factory=Style)
    dummy_run: bool = False
    verbose: bool = False
    no_cache: bool = False
    cache_dir: str | None = None
    strict: bool = True
    icon: str | None = None
