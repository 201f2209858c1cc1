"""``python -m mapframe.cli [OPTION]... FILE``: the pictures of one or more city configurations, as display lists."""

from __future__ import annotations

import argparse
import logging
import re
import shlex
import sys
from dataclasses import replace
from pathlib import Path

from mapframe.schema import RunOptions, Style

# Option names that set a colour of the style.
COLORS = {
    "active-area-font-color": "active_label",
    "active-area-font-bgcolor": "active_label_background",
    "active-area-color": "active_area",
    "inactive-area-font-color": "inactive_label",
    "inactive-area-color": "inactive_area",
    "landmark-color": "landmark_label",
    "landmark-bullet-color": "landmark_bullet",
    "land-color": "land",
    "water-color": "water",
    "park-color": "park",
    "hover-area-color": "hover_area",
    "hover-park-color": "hover_park",
}
FONTS = ("active-area-font", "inactive-area-font", "landmark-font")
VERSION = "0.1"


def c_integer(text: str, bits: int = 64) -> int:
    """An integer as C reads it with base 0, from the start of the text; 0 where there is none."""
    found = re.match(r"\s*([+-]?)(0[xX][0-9a-fA-F]+|0[0-7]*|[1-9][0-9]*)?", text)
    digits = found[2] or "0"
    value = int(digits, 16) if digits[:2] in ("0x", "0X") else int(digits, 8) if digits[0] == "0" else int(digits)
    value = min(value, (1 << 63) - 1)
    return (-value if found[1] == "-" else value) & ((1 << bits) - 1)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="mapframe", allow_abbrev=True, description=__doc__)
    for name in COLORS:
        out.add_argument(f"--{name}", metavar="COLOR")
    for name in FONTS:
        out.add_argument(f"--{name}", metavar="FONT", help="accepted and not used: sizes and styles follow from the picture")
    out.add_argument("--size", default="396", help="pixels of the large pictures, both ways")
    out.add_argument("--prefix", default="output")
    out.add_argument("--map-directory", default=".")
    out.add_argument("--map-file")
    out.add_argument("--park-icon", help="a PNG file that marks a park; otherwise a small tree does")
    out.add_argument("--cache-dir", help="folder of kept backdrops")
    out.add_argument("--options-file", help="a file of further options, as in a shell")
    for name in ("dummy-run", "verbose", "no-cache", "lenient"):
        out.add_argument(f"--{name}", action="store_true")
    out.add_argument("--version", action="version", version=VERSION)
    out.add_argument("file", nargs="+", metavar="FILE", help="city configurations")
    return out


def parse_options(argv: list[str]) -> list[RunOptions]:
    """One :class:`RunOptions` a configuration. With several, each one's name joins the prefix."""
    given = parser().parse_args(argv)
    if given.options_file:
        given = parser().parse_args([*shlex.split(Path(given.options_file).read_text()), *argv])
    for name in FONTS:
        if getattr(given, name.replace("-", "_")):
            logging.getLogger("mapframe").warning("--%s has no effect", name)
    colors = {field: c_integer(text, 32) for name, field in COLORS.items() if (text := getattr(given, name.replace("-", "_"))) is not None}
    shared = RunOptions("", given.map_directory, given.map_file, given.prefix, c_integer(given.size), Style(**colors), given.dummy_run, given.verbose, given.no_cache, given.cache_dir, not given.lenient, given.park_icon)
    many = len(given.file) > 1
    return [replace(shared, config=f, prefix=f"{given.prefix}-{Path(f).stem}" if many else given.prefix) for f in given.file]


def main(argv: list[str] | None = None) -> int:
    runs = parse_options(sys.argv[1:] if argv is None else argv)
    logging.basicConfig(level=logging.INFO if runs[0].verbose else logging.WARNING)
    from pyspark.sql import SparkSession

    from mapframe.plans.render import write_city

    spark = SparkSession.builder.appName("mapframe").getOrCreate()
    for run in runs:
        write_city(spark, run)
    return 0


if __name__ == "__main__":
    sys.exit(main())
