"""What the training-data operators share: the shared folder, written tables, text batches.

Nothing outside ``mapframe.llm`` imports this subpackage.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import broadcast

#: Bytes of text that a Python worker holds as one block; a longer single text makes a block of its own.
BLOCK_BYTES = 2 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Unset, a local master gets a temporary folder, which is then the session's setting; a cluster gets an error,
    since a machine-local folder would not be seen by the other machines.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_mapframe_shared", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="mapframe-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark._mapframe_shared = f"file://{path}"
    spark.sparkContext.setCheckpointDir(spark._mapframe_shared)
    return spark._mapframe_shared


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends (or by :func:`remove`)."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session is gone: the folder is its owner's to clear
            return


def written(df: DataFrame, name: str, among: list[DataFrame] | None = None, by: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here and survives lost executors. The table is
    added to ``among``, if given, a list of those that :func:`drop_all` removes; ``by`` are columns that make its folders."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*(by or [])).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mapframe_path = path
    if among is not None:
        among.append(out)
    return out


def drop_written(df: DataFrame) -> None:
    """Remove a table made by :func:`written` whose rows nobody needs any more."""
    remove(df.sparkSession, df._mapframe_path)


def drop_all(tables: list[DataFrame]) -> None:
    for table in tables:
        drop_written(table)
    tables.clear()


#: Bytes of a side of a join that may be broadcast.
MOST_BROADCAST = 32 << 20
#: Rows of one key from which on its rows are dealt to several tasks; of a larger table, this share of its rows.
LEAST_SPREAD, SPREAD = 512, 1 << 16


def _width(value: Column, kind: T.DataType) -> Column:
    """The bytes of a value, about as a broadcast holds it."""
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StructType, T.StringType, T.BinaryType, T.ArrayType)):
            return F.coalesce(F.aggregate(value, F.lit(24).cast("long"), lambda total, x: total + _width(x, kind.elementType)), F.lit(24))
        return F.coalesce(F.size(value), F.lit(0)).cast("long") * 8 + 24
    return F.lit(8).cast("long")


def fits(df: DataFrame, most: int = MOST_BROADCAST) -> bool:
    """Whether the bytes of ``df``, which are summed, are at most ``most``."""
    each = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    return (df.agg(F.sum(each)).first()[0] or 0) <= most


def bounded(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, to be broadcast if it :func:`fits`; otherwise the join shuffles both sides."""
    return broadcast(df) if fits(df, most) else df


def spread_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, total: int, by: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` where one key may hold a large share of ``left``.

    ``counts(*on, n)`` says how many of the ``total`` rows of ``left`` a key has. The rows of a key with more than ``each``,
    a 65,536th of all but not less than 512, are dealt by a hash of their columns ``by``, and the key's rows of ``right`` are
    repeated for each share. At most ``total / each`` keys, so 65,536, have more than ``each`` rows: that bounds what is
    broadcast, three numbers a key.
    """
    each = max(LEAST_SPREAD, total // SPREAD)
    parts, salt = spare([*left.columns, *right.columns], "_parts", "_salt")
    hot = broadcast(counts.where(F.col("n") > each).select(*on, F.ceil(F.col("n") / each).cast("int").alias(parts)))
    share = F.coalesce(F.pmod(F.xxhash64(*by, F.lit(7)), F.col(parts)).cast("int"), F.lit(0))
    dealt = left.join(hot, on, "left").withColumn(salt, share).drop(parts)
    repeated = right.join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return dealt.join(repeated, [*on, salt], how).drop(salt)


def spare(taken: list[str], *names: str) -> list[str]:
    """Names like ``names`` that clash with none of ``taken``, whatever their case."""
    known, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in known:
            name = "_" + name
        known.add(name.lower())
        out.append(name)
    return out


def filesystem(uri: str):
    """``(pyarrow filesystem, path)`` of a URI or a plain local path, for Python tasks that write or map files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def text_of(column: pa.Array) -> pa.Array:
    """A text column without nulls (null counts as empty), as one string array starting at offset 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string()) if column.type != pa.string() else column
    if column.null_count:
        column = pc.fill_null(column, "")
    if column.offset:
        column = pa.concat_arrays([column])
    return column


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in slices of at most ``most`` bytes of ``column`` (one row at least).

    Small neighbouring batches are joined first, so that each slice is worth the fixed cost of a vectorised step.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first, before = np.cumsum(sizes), 0, 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(ends, before + most - size, "right")))
            taken = int(ends[last - 1] - before)
            if held and size + taken > most:
                yield _joined(held)
                held, size = [], 0
                continue
            held.append(batch.slice(first, last - first))
            size += taken
            before, first = int(ends[last - 1]), last
            if size >= most or sum(x.num_rows for x in held) >= 100_000:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)
        held = []
    give_back()


def give_back() -> None:
    """Return memory that is free to the system: a worker lives on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def offsets_of(array: pa.Array) -> np.ndarray:
    """The n + 1 offsets of a string, binary or list array, from 0."""
    got = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return got - got[0] if len(got) else np.zeros(1, np.int64)


def bytes_of(array: pa.Array) -> np.ndarray:
    """The bytes of a string array with no nulls, without gaps, as uint8."""
    raw = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[raw[0] : raw[-1]] if data is not None and len(array) else np.zeros(0, np.uint8)


def byte_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """A translation of single bytes: A-Z to a-z, each separator to a space. Bytes of other characters stay."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 32
    return table


#: The separators of words ``[^\\x20\\x09-\\x0D]+``.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: The separators of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
NOT_WORD = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))


def words(texts: pa.Array, separators: bytes, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """``(all words of all texts, offsets per text)``, split at runs of separator bytes, A-Z lower-cased if ``lower``.

    Works on the bytes of the whole block at once: every separator is ASCII, so no UTF-8 sequence is cut.
    """
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    data = byte_table(separators, lower)[bytes_of(texts)]
    bounds = offsets_of(texts)
    start, end = word_spans(data, bounds)
    counts = np.searchsorted(start, bounds)
    # Words without the separators between them: take the bytes that are not separators.
    keep = data[data != 32]
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(keep)), counts


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of runs that are not spaces; a run also ends where a text ends."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = data != 32
    begins = solid[1:-1] & ~solid[:-2]
    stops = solid[1:-1] & ~solid[2:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] |= solid[1:-1][inner]
    stops[inner - 1] |= solid[1:-1][inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def spaced(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, n + 1 starts)`` of words, each followed by one space: words ``a..b`` are ``bytes[at[a] : at[b] - 1]``."""
    offsets = offsets_of(flat) if len(flat) else np.zeros(1, np.int64)
    at = offsets + np.arange(len(offsets))
    data = np.full(int(at[-1]), 32, np.uint8)
    data[ranges(at[:-1], np.diff(offsets))] = bytes_of(flat)
    return data, at


def group_rows(offsets: np.ndarray) -> np.ndarray:
    """For each item of a ragged array, the number of its row."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + n)`` for each pair."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
