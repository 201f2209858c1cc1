"""Display lists as pixels, and pixels as PNG files.

A picture is one group of rows and is bounded by its size, so each is drawn by one call and pictures are drawn in
parallel. Shapes are filled by the non-zero winding rule on four sub-lines a pixel line; strokes are filled quads with
round joints. There is no font: a text fills the rows of small blocks that its letters would take.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_SUB = 4
Points = list[tuple[float, float]]


def coverage(shapes: list[Points], width: int, height: int) -> np.ndarray:
    """How much of each pixel the shapes cover together, from 0 to 1."""
    out = np.zeros((height, width))
    edges = [(a, b) for shape in shapes if len(shape) > 2 for a, b in zip(shape, [*shape[1:], shape[0]], strict=True) if a[1] != b[1]]
    if not edges:
        return out
    (x0, y0), (x1, y1) = (np.array([e[k] for e in edges], float).T for k in (0, 1))
    low, high, sign = np.minimum(y0, y1), np.maximum(y0, y1), np.where(y1 > y0, 1, -1)
    slope = (x1 - x0) / (y1 - y0)
    for line in range(max(0, int(np.floor(low.min()) * _SUB)), min(height * _SUB, int(np.ceil(high.max()) * _SUB))):
        y = (line + 0.5) / _SUB
        on = (low <= y) & (y < high)
        if not on.any():
            continue
        x = x0[on] + (y - y0[on]) * slope[on]
        order = np.argsort(x, kind="stable")
        x, wind = x[order], np.cumsum(sign[on][order])
        row = out[line // _SUB]
        for a, b in zip(x[:-1][wind[:-1] != 0], x[1:][wind[:-1] != 0], strict=True):
            a, b = max(0.0, a), min(float(width), b)
            if b <= a:
                continue
            first, last = int(a), min(int(b), width - 1)
            if first == last:
                row[first] += (b - a) / _SUB
            else:
                row[first] += (first + 1 - a) / _SUB
                row[first + 1 : last] += 1 / _SUB
                row[last] += (b - last) / _SUB
    return np.minimum(out, 1)


def stroke(points: Points, width: float) -> list[Points]:
    """The outline of a line: a quad for each segment and a circle at each joint."""
    half, out = width / 2, []
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        length = np.hypot(bx - ax, by - ay)
        if length:
            nx, ny = (ay - by) / length * half, (bx - ax) / length * half
            out.append([(ax + nx, ay + ny), (bx + nx, by + ny), (bx - nx, by - ny), (ax - nx, ay - ny)])
    angles = np.linspace(0, 2 * np.pi, 9)[:-1]
    for x, y in points[1:-1]:
        out.append([(x + half * np.cos(t), y + half * np.sin(t)) for t in angles[::-1]])
    return [_clockwise(s) for s in out]


def _clockwise(shape: Points) -> Points:
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(shape, [*shape[1:], shape[0]], strict=True))
    return shape if area >= 0 else shape[::-1]


def rectangle(points: Points) -> Points:
    (x0, y0), (x1, y1) = points
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def rounded(points: Points, radius: float) -> Points:
    """A rectangle whose corners are quarter circles."""
    (x0, y0), (x1, y1) = points
    r = min(radius, (x1 - x0) / 2, (y1 - y0) / 2)
    out = []
    for k, (x, y) in enumerate(((x0 + r, y0 + r), (x1 - r, y0 + r), (x1 - r, y1 - r), (x0 + r, y1 - r))):
        out += [(x + r * np.cos(t), y + r * np.sin(t)) for t in np.linspace(np.pi * (1 + k / 2), np.pi * (1.5 + k / 2), 6)]
    return out


def tree(size: int = 16) -> np.ndarray:
    """The mark of a park: a crown on a trunk."""
    out = np.zeros((size, size, 4))
    turn = np.linspace(0, 2 * np.pi, 25)[:-1]
    blend(out, 0xFF7A5C3E, coverage([rectangle([(size * 0.44, size * 0.55), (size * 0.56, size * 0.95)])], size, size))
    blend(out, 0xFF5F9E4A, coverage([[(size * (0.5 + 0.32 * np.cos(t)), size * (0.38 + 0.32 * np.sin(t))) for t in turn]], size, size))
    return np.round(out * 255).astype(np.uint8)


def paint(canvas: np.ndarray, image: np.ndarray, center: tuple[float, float]) -> None:
    """Lay an image (RGBA, premultiplied) over the canvas, its centre at a point, half its size rounded to whole pixels."""
    height, width = image.shape[:2]
    left, top = (int(np.floor(c + 0.5)) - int(np.floor(n * 0.5 + 0.5)) for c, n in zip(center, (width, height), strict=True))
    x0, y0, x1, y1 = max(left, 0), max(top, 0), min(left + width, canvas.shape[1]), min(top + height, canvas.shape[0])
    if x0 < x1 and y0 < y1:
        own = image[y0 - top : y1 - top, x0 - left : x1 - left] / 255
        canvas[y0:y1, x0:x1] = canvas[y0:y1, x0:x1] * (1 - own[..., 3:]) + own


def text_blocks(text: str, points: Points, font_size: float = 10) -> list[Points]:
    """A block for each letter that is not a space."""
    x, y = points[0]
    step, out = font_size * 0.6, []
    for r, line in enumerate((text or "").split("\n")):
        for c, letter in enumerate(line):
            if letter != " ":
                left, top = x + c * step, y + r * font_size + font_size * 0.3
                out.append(rectangle([(left, top), (left + step * 0.7, top + font_size * 0.5)]))
    return out


def blend(canvas: np.ndarray, color: int, cover: np.ndarray, op: str = "over") -> None:
    """Paint a colour (ARGB) through a coverage onto premultiplied RGBA, in place."""
    alpha = ((color >> 24) & 255) / 255 * cover
    if op == "dest_out":
        canvas *= (1 - alpha)[..., None]
        return
    rgb = np.array([(color >> s) & 255 for s in (16, 8, 0)]) / 255
    canvas *= (1 - alpha)[..., None]
    canvas[..., :3] += alpha[..., None] * rgb
    canvas[..., 3] += alpha


def draw(commands: list[dict], width: int, height: int, icon: np.ndarray | None = None) -> np.ndarray:
    """RGBA (uint8) of commands in their order. Backdrop commands are drawn on a surface of their own, so that erased
    bridges show what is under the water; areas are drawn through the mask of all of them without their outlines."""
    canvas = np.zeros((height, width, 4))
    layers = {k: [c for c in commands if c["z"] >> 32 == k] for k in range(7)}
    shape = lambda c: [(p["x"], p["y"]) for p in c["points"]]

    def cover(c: dict) -> np.ndarray:
        cmd, points = c["cmd"], shape(c)
        if cmd == "stroke":
            return coverage(stroke(points, c["width"]), width, height)
        if cmd == "rect_round":
            return coverage([rounded(points, c["width"])], width, height)
        if cmd == "rect":
            return coverage([rectangle(points)], width, height)
        if cmd == "text":
            return coverage(text_blocks(c["text"], points), width, height)
        return coverage([points], width, height)

    def surface(rows: list[dict]) -> None:
        if rows:
            own = np.zeros_like(canvas)
            coast = [c for c in rows if c["cmd"] == "fill_multi"]
            if coast:
                blend(own, coast[0]["color"], coverage([shape(c) for c in coast], width, height))
            for c in rows:
                if c["cmd"] != "fill_multi":
                    blend(own, c["color"], cover(c), c["op"])
            canvas[...] = canvas * (1 - own[..., 3:]) + own

    for c in layers[0]:
        blend(canvas, c["color"], cover(c))
    surface(layers[1])
    if layers[2]:
        fills, source = layers[2], np.zeros_like(canvas)
        mask = coverage([shape(c) for c in fills], width, height)
        mask *= 1 - coverage([s for c in layers[3] for s in stroke(shape(c), c["width"])], width, height)
        for c in fills:
            blend(source, c["color"], cover(c))
        source *= mask[..., None]
        canvas[...] = canvas * (1 - source[..., 3:]) + source
    surface(layers[4])
    for c in [*layers[5], *layers[6]]:
        if c["cmd"] == "icon":
            paint(canvas, tree() if icon is None else icon, shape(c)[0])
        else:
            blend(canvas, c["color"], cover(c))
    return np.round(np.clip(canvas, 0, 1) * 255).astype(np.uint8)


def png(pixels: np.ndarray) -> bytes:
    """An RGBA image as a PNG file."""
    height, width = pixels.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """RGBA of an 8-bit grey, RGB or RGBA PNG without interlace."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, parts, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        head = struct.unpack(">2I5B", body) if kind == b"IHDR" else head
        parts += [body] if kind == b"IDAT" else []
        at += size + 12
    width, height, depth, color, _, _, interlace = head
    bands = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or interlace or bands is None:
        raise ValueError("only 8-bit grey, RGB and RGBA images without interlace can be read")
    raw, stride = zlib.decompress(b"".join(parts)), width * bands
    out, above = np.zeros((height, stride), np.uint8), np.zeros(stride, np.int64)
    for y in range(height):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(-1, bands), axis=0).ravel() & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            for x in range(stride):
                left, corner = (line[x - bands], above[x - bands]) if x >= bands else (0, 0)
                guess = left + above[x] - corner
                near = min((abs(guess - left), 0, left), (abs(guess - above[x]), 1, above[x]), (abs(guess - corner), 2, corner))[2]
                line[x] = (line[x] + ((left + above[x]) // 2 if kind == 3 else near)) & 255
        out[y], above = line, line
    pixels = out.reshape(height, width, bands)
    grey, alpha = bands < 3, bands in (2, 4)
    rgb = np.repeat(pixels[..., :1], 3, axis=2) if grey else pixels[..., :3]
    return np.concatenate([rgb, pixels[..., -1:] if alpha else np.full((height, width, 1), 255, np.uint8)], axis=2)


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, width, height, rgba`` of PNG files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            images = [read_png(x) for x in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "width": [i.shape[1] for i in images], "height": [i.shape[0] for i in images], "rgba": [i.tobytes() for i in images]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, width int, height int, rgba binary")


def pictures(commands: DataFrame, keys: list[str], icon: np.ndarray | None = None) -> DataFrame:
    """``keys, width, height, rgba``: a drawn picture for each group of commands; its size is that of its tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                size = r["_size"]
                drawn = {**{k: [r[k]] for k in keys}, "width": [size], "height": [size], "rgba": [draw(r["_c"], size, size, icon).tobytes()]}
                yield pa.RecordBatch.from_pydict(drawn, schema=arrow)

    # A picture's commands are few and its size is fixed, so a group is small; the place in the order of painting comes first.
    row = F.struct("z", "cmd", "color", "width", "op", "text", "points")
    drawn = commands.groupBy(*keys).agg(F.max("tile").alias("_size"), F.array_sort(F.collect_list(row)).alias("_c"))
    schema = T.StructType([*(commands.schema[k] for k in keys), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgba", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    return drawn.mapInArrow(run, schema)


def changed(picture: np.ndarray, base: np.ndarray) -> np.ndarray:
    """``picture`` where it differs from ``base``, transparent elsewhere."""
    return np.where((picture != base).any(axis=2, keepdims=True), picture, 0).astype(np.uint8)


def atlas(images: list[np.ndarray]) -> np.ndarray:
    """Images on shelves in one image about as wide as it is high, the highest first."""
    order = sorted(range(len(images)), key=lambda k: (-images[k].shape[0], k))
    limit = max(int(np.ceil(np.sqrt(sum(i.shape[0] * i.shape[1] for i in images)))), max((i.shape[1] for i in images), default=1))
    places, x, y, shelf = {}, 0, 0, 0
    for k in order:
        h, w = images[k].shape[:2]
        if x + w > limit:
            x, y, shelf = 0, y + shelf, 0
        places[k] = (x, y)
        x, shelf = x + w, max(shelf, h)
    out = np.zeros((y + shelf, limit, 4), np.uint8)
    for k, (left, top) in places.items():
        out[top : top + images[k].shape[0], left : left + images[k].shape[1]] = images[k]
    return out


def trimmed(picture: np.ndarray) -> np.ndarray:
    """Without transparent margins; one transparent pixel if nothing is left."""
    ys, xs = np.nonzero(picture[..., 3])
    return picture[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] if len(ys) else np.zeros((1, 1, 4), np.uint8)
