"""Colours and fonts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapframe.schema import Style

_MASK = 0xFFFFFFFF


def parse_color(text: Column) -> Column:
    """A colour as C reads an integer: blanks and a sign, then ``0x`` hexadecimal, ``0`` octal or decimal, up to the first
    other character, as 32 bits; 0 where there is no digit."""
    sign = F.regexp_extract(text, r"^\s*([+-]?)", 1)
    rest = F.regexp_replace(text, r"^\s*[+-]?", "")
    hexes, octal, decimal = (F.regexp_extract(rest, p, 1) for p in (r"^0[xX]([0-9a-fA-F]+)", r"^(0[0-7]*)", r"^([1-9][0-9]*)"))
    most = F.lit((1 << 63) - 1).cast("decimal(20,0)")
    # Strings of so many digits that they can't be below the largest number are not converted.
    value = lambda digits, base, room: F.when(F.length(F.ltrim(digits, F.lit("0"))) > room, most).otherwise(F.conv(digits, base, 10).cast("decimal(20,0)"))
    figures = F.when(hexes != "", value(hexes, 16, 16)).when(octal != "", value(octal, 8, 21)).when(decimal != "", value(decimal, 10, 19)).otherwise(F.lit(0).cast("decimal(20,0)"))
    value = F.least(figures, most).cast("long")
    return F.when(sign == "-", -value).otherwise(value).bitwiseAND(F.lit(_MASK))


def mean_color(a: Column, b: Column) -> Column:
    half = lambda c: F.shiftrightunsigned(c, 1).bitwiseAND(F.lit(0x7F7F7F7F))
    return half(a) + half(b)


def area_color(kind: Column, mode: Column, is_active: Column, style: Style) -> Column:
    """The fill of an area: by type (2 is a park), and for the active one by mode."""
    park = kind == 2
    plain = F.when(park, style.park).otherwise(F.lit(style.inactive_area))
    hover = F.when(park, style.hover_park).otherwise(F.lit(style.hover_area))
    return F.when(is_active & mode.isin("ACTIVE", "CALLOUT"), F.lit(style.active_area)).when(is_active & (mode == "HOVER"), hover).otherwise(plain)


def font(size: Column, bold: Column) -> Column:
    """``name style size``; small sizes are hinted lightly."""
    return F.concat_ws(" ", F.lit("Arial"), F.when(bold, "Bold"), size.cast("string"), F.when(size < 11, "light"))


def callout_name(prefix: str, index: Column) -> Column:
    return F.format_string("%s-%02d-callout.png", F.lit(prefix), index)
