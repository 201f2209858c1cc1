"""The ``osmpbf`` data source: OpenStreetMap PBF files as tables.

``spark.read.format("osmpbf").option("entity", e).load(path)`` with ``header``, ``nodes``, ``ways``, ``relations`` or
``blobs`` for ``e``. A path is a file, or a directory whose ``*.osm.pbf`` files are read (not below it); several paths
are joined by commas in the option ``paths``. Planning walks the frames of a file by seeking from header to header; a
partition is a run of blobs of about ``partition_bytes``; a task decodes a blob at a time into one Arrow batch. Since
column pruning does not reach a Python source, each entity decodes its own fields only.

Options: ``strict`` (default true: a tag key that repeats within a way is an error; otherwise the last value counts),
``fixed_granularity`` (coordinates in steps of 100 nanodegrees whatever the block says), ``box`` (nodes only: least latitude
and longitude and largest, in nanodegrees with commas between them; other nodes are left out while decoding).

The source takes no filters from Spark: what one scan of a DataFrame pushes down to a Python source also holds for the other
scans of the same DataFrame, and the rectangle query reads its nodes both with and without a box.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from mapframe.schema import ENTITIES
from mapframe.sources import wire

SUFFIX = ".osm.pbf"
_HEADER, _DATA = "OSMHeader", "OSMData"
_MEMBERS = ("NODE", "WAY", "RELATION")


def open_path(path: str):
    """``(file system, path)``: plain paths are local, URIs are resolved by their scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The files of a path, in order of their names."""
    from pyarrow import fs

    system, at = open_path(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [path]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    found = (f for f in system.get_file_info(fs.FileSelector(at, recursive=False)) if f.is_file and f.path.endswith(SUFFIX))
    return sorted(prefix + f.path for f in found)


def frames(path: str, only_first: bool = False) -> Iterator[tuple[int, int, str, int]]:
    """``(number, offset of the blob, type, size)`` of each block, reading block headers only."""
    system, at = open_path(path)
    with system.open_input_file(at) as file:
        size, offset, number = file.size(), 0, 0
        while offset < size:
            if offset + 4 > size:
                raise ValueError(f"{path}: the file ends within the length of a header")
            length = int.from_bytes(file.read_at(4, offset), "big")
            if offset + 4 + length > size:
                raise ValueError(f"{path}: a block header goes beyond the end of the file")
            head = wire.fields(file.read_at(length, offset + 4))
            kind, datasize = bytes(wire.last(head, 1, b"")).decode(), wire.last(head, 3, 0)
            offset += 4 + length
            if offset + datasize > size:
                raise ValueError(f"{path}: a blob goes beyond the end of the file")
            yield number, offset, kind, datasize
            if only_first:
                return
            offset, number = offset + datasize, number + 1


def inflated(blob: bytes) -> tuple[bytes, str]:
    """``(payload, codec)`` of a blob; stored or zlib. A stated size is checked."""
    found = wire.fields(blob)
    if 1 in found:
        data, codec = bytes(found[1][-1]), "raw"
    elif 3 in found:
        data, codec = zlib.decompress(found[3][-1]), "zlib"
    else:
        raise ValueError("unsupported compression of a blob: only stored and zlib data can be read")
    if 2 in found and found[2][-1] != len(data):
        raise ValueError(f"a blob holds {len(data)} bytes and says {found[2][-1]}")
    return data, codec


def header_row(path: str, payload: bytes) -> dict:
    found = wire.fields(payload)
    bbox = {k: wire.signed(v[-1]) for k, v in wire.fields(found[1][-1]).items()} if 1 in found else {}
    text = lambda n: bytes(found[n][-1]).decode() if n in found else None
    return {"path": path, "left_nano": bbox.get(1), "right_nano": bbox.get(2), "top_nano": bbox.get(3), "bottom_nano": bbox.get(4), "required_features": [bytes(x).decode() for x in found.get(4, [])], "optional_features": [bytes(x).decode() for x in found.get(5, [])], "program": text(16), "source": text(17)}


class Block:
    """A decoded data block: strings, groups, and the transformation of coordinates."""

    def __init__(self, payload: bytes, fixed_granularity: bool = False, strict: bool = True):
        found = wire.fields(payload)
        self.strings = [bytes(s).decode("utf-8", "replace") for s in wire.fields(wire.last(found, 1, b"")).get(1, [])]
        self.groups = [wire.fields(g) for g in found.get(2, [])]
        self.step = 100 if fixed_granularity else wire.last(found, 17, 100)
        self.lat, self.lon = (wire.int64(wire.last(found, n, 0)) for n in (19, 20))
        self.strict = strict

    def tags(self, found: wire.Fields, unique: bool) -> pa.Array:
        """The tags of each message; of a key that repeats, the last value counts."""
        (keys, many), (values, others) = wire.repeated(found, 2), wire.repeated(found, 3)
        if unique and self.strict and (many != others).any():
            raise ValueError("a way has keys without values")
        keys, values, many = paired(keys, many, values, others)
        first = {s: k for k, s in reversed(list(enumerate(self.strings)))}
        same = np.array([first[s] for s in self.strings], np.int64)
        if len(keys) and max(keys.max(), values.max()) >= len(self.strings):
            raise ValueError("a tag is not in the table of strings")
        keys, row = same[keys.astype(np.int64)], np.repeat(np.arange(len(many)), many)
        pair = row * len(self.strings) + keys
        known, at = np.unique(pair, return_index=True)
        if len(known) != len(pair):
            if unique and self.strict:
                raise ValueError("a tag key repeats within a way")
            _, behind = np.unique(pair[::-1], return_index=True)
            order = np.argsort(at)
            at, latest = at[order], len(pair) - 1 - behind[order]
            keys, values, many = keys[at], values[latest], np.bincount(row[at], minlength=len(many))
        strings = pa.array(self.strings, pa.string())
        return pa.MapArray.from_arrays(ends(many), strings.take(pa.array(keys)), strings.take(pa.array(values)))

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, latitudes, longitudes)`` in nanodegrees, of dense and of single nodes."""
        ids, lats, lons = [], [], []
        for group in self.groups:
            for one in group.get(1, []):
                node = wire.fields(one)
                ids.append(np.array([wire.signed(wire.last(node, 1, 0))]))
                lats.append(np.array([wire.signed(wire.last(node, 8, 0))]))
                lons.append(np.array([wire.signed(wire.last(node, 9, 0))]))
            for one in group.get(2, []):
                dense = wire.fields(one)
                for to, number in ((ids, 1), (lats, 8), (lons, 9)):
                    to.append(wire.running(dense.get(number, [])))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(ids).astype(np.int64), self.lat + self.step * join(lats), self.lon + self.step * join(lons)

    def messages(self, number: int) -> wire.Fields:
        return wire.scan([one for group in self.groups for one in group.get(number, [])])

    def ways(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """``(ids, tags, references)``."""
        found = self.messages(3)
        refs, many = wire.repeated(found, 8)
        return wire.single(found, 1), self.tags(found, True), pa.ListArray.from_arrays(ends(many), pa.array(wire.running_each(refs, many)))

    def relations(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """``(ids, tags, members)``."""
        found = self.messages(4)
        (types, many), (refs, others) = wire.repeated(found, 10), wire.repeated(found, 9)
        types, refs, many = paired(types, many, wire.running_each(refs, others), others)
        place = np.arange(len(types)) - np.repeat(np.cumsum(many) - many, many)
        member = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(_MEMBERS).take(pa.array(types)), pa.array(refs)], ["pos", "type", "ref"])
        return wire.single(found, 1), self.tags(found, False), pa.ListArray.from_arrays(ends(many), member)


def ends(many: np.ndarray) -> pa.Array:
    """Offsets of lists of these lengths."""
    return pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32())


def paired(a: np.ndarray, many: np.ndarray, b: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two columns of lists, each list cut to the shorter of both: ``(a, b, lengths)``."""
    least = np.minimum(many, others)
    inner = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) < np.repeat(least, n)
    return a[inner(many)], b[inner(others)], least


class Blobs(InputPartition):
    """A run of blobs ``(number, offset, size, kind)`` of one file."""

    def __init__(self, path: str, blobs: list[tuple[int, int, int, str]]):
        self.path, self.blobs = path, blobs


class PbfReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.entity = options.get("entity", "nodes")
        self.paths = [p for p in (options.get("paths") or options.get("path") or "").split(",") if p]
        self.bytes = int(options.get("partition_bytes", 32 << 20))
        self.strict = options.get("strict", "true").lower() == "true"
        self.fixed = options.get("fixed_granularity", "false").lower() == "true"
        corners = [int(n) for n in options.get("box", "").split(",") if n]
        if corners and (len(corners) != 4 or self.entity != "nodes"):
            raise ValueError("box is four numbers, and for nodes")
        self.bounds = {"lat_nano": corners[::2], "lon_nano": corners[1::2]} if corners else {}

    def partitions(self) -> list[Blobs]:
        out = []
        for path in (file for p in self.paths for file in listed(p)):
            if self.entity == "header":
                out.append(Blobs(path, [(n, o, size, kind) for n, o, kind, size in frames(path, True) if kind == _HEADER]))
                continue
            held, size = [], 0
            for number, offset, kind, datasize in frames(path):
                if self.entity != "blobs" and kind != _DATA:
                    continue
                held.append((number, offset, datasize, kind))
                size += datasize
                if size >= self.bytes:
                    out.append(Blobs(path, held))
                    held, size = [], 0
            if held:
                out.append(Blobs(path, held))
        return out

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        system, at = open_path(partition.path)
        with system.open_input_file(at) as file:
            for number, offset, size, kind in partition.blobs:
                payload, codec = inflated(file.read_at(size, offset))
                if self.entity == "header":
                    yield self._batch([header_row(partition.path, payload)])
                elif self.entity == "blobs":
                    yield self._batch([{"path": partition.path, "idx": number, "offset": offset, "type": kind, "datasize": size, "codec": codec}])
                else:
                    yield self._decoded(partition.path, number, Block(payload, self.fixed, self.strict))

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=_arrow(self.entity))

    def _decoded(self, path: str, number: int, block: Block) -> pa.RecordBatch:
        schema, first = _arrow(self.entity), number << 32
        if self.entity == "nodes":
            columns = dict(zip(("node_id", "lat_nano", "lon_nano"), block.nodes(), strict=True))
            order = first + np.arange(len(columns["node_id"]))
            keep = np.ones(len(order), bool)
            for name, (low, high) in self.bounds.items():
                keep &= (columns[name] >= low) & (columns[name] <= high)
            numbers = [order[keep], *(c[keep] for c in columns.values())]
            return pa.RecordBatch.from_arrays([pa.array([path] * len(numbers[0]), pa.string()), *map(pa.array, numbers)], schema=schema)
        ids, tags, third = block.ways() if self.entity == "ways" else block.relations()
        numbers = [pa.array([path] * len(ids), pa.string()), pa.array(first + np.arange(len(ids)), pa.int64()), pa.array(ids)]
        return pa.RecordBatch.from_arrays([*numbers, tags.cast(schema.field(3).type), third.cast(schema.field(4).type)], schema=schema)


def _arrow(entity: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ENTITIES[entity])


class PbfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> StructType:
        entity = self.options.get("entity", "nodes")
        if entity not in ENTITIES:
            raise ValueError(f"entity is one of {', '.join(ENTITIES)}, not {entity}")
        return ENTITIES[entity]

    def reader(self, schema: StructType) -> PbfReader:
        return PbfReader(dict(self.options), schema)


def read_pbf(spark: SparkSession, paths: str | list[str], entity: str, **options) -> DataFrame:
    """A table of one or more files or directories."""
    spark.dataSource.register(PbfDataSource)
    paths = [paths] if isinstance(paths, str) else paths
    reader = spark.read.format("osmpbf").option("entity", entity).option("paths", ",".join(paths))
    for key, value in options.items():
        reader = reader.option(key, str(value).lower() if isinstance(value, bool) else str(value))
    return reader.load()
