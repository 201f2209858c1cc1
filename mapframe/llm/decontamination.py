"""Benchmark decontamination: a prefix-filtered containment join over item-sized windows.

A window is ``window`` consecutive words of an item (all of them, if it has fewer); as a set it holds its shingles of five
words with their places (of a shorter window, the one shingle of all its words). It occurs in a document where all of its
shingles are contained at their places. A containment of 1 needs a prefix of one shingle: the one that is rarest in the
corpus. So

1. one pass counts the shingles of the items over all documents, which orders them by rarity; a window with a shingle
   that no document has can't occur and is left out;
2. each other window is filed under its rarest shingle, with the place of that in it;
3. a second pass proposes each place of a document where such a shingle stands, with the words around it; they are joined
   with the windows on the shingle, and the length bound (the window ends within the document), the positional bound (the
   shingle stands at its place in the window) and the equality of all words decide.

Both sides are tables of any size. What is sent to all tasks is a table of bits, at most 32 MB, which tells shingles that
are surely none of an item's; it only saves work. Joins broadcast a side whose bytes were summed to be few, and otherwise
deal the rows of frequent shingles, windows and passages to several tasks.

Defined results: null text has no words; items without words, with null text or a null id take no part; repeated items
count once; repeated document rows each give a row; an empty benchmark leaves all documents clean; key columns named like
a result column are an error, other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapframe.llm.common import NOT_WORD, blocks, bounded, drop_all, fits, ranges, spaced, spare, spread_join, text_of, words, written
from mapframe.llm.hashing import RangeHashes, mixed

COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
WINDOW, SHINGLE = 10, 5
#: Bits of the table of shingles: at least, for each shingle, at most; bits of one slice of it.
LEAST_BITS, BITS_EACH, MOST_BITS, SLICE = 1 << 16, 64, 1 << 28, 1 << 16
#: Bytes of text whose shingles a worker holds at once.
BLOCK_BYTES = 512 << 10
#: Candidates in one row of the second pass.
_CHUNK = 2048
_NONE = hashlib.sha256(b"").hexdigest()


class Shingles:
    """The words of a block of texts and the keys of their shingles."""

    def __init__(self, texts: pa.Array):
        self.flat, self.bounds = words(text_of(texts), NOT_WORD)
        self.hash = RangeHashes(self.flat)

    def all(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """``(first words, keys)`` of the shingles of ``size`` words of every text."""
        first = ranges(self.bounds[:-1], np.maximum(np.diff(self.bounds) - size + 1, 0))
        return first, mixed(self.hash(first, first + size), np.full(len(first), size))


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """``item_id, w, n, keys``: every window of every item, its words joined by spaces, and the keys of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most=256 << 10):
            found = Shingles(block.column("text"))
            n_words = np.diff(found.bounds)
            many = np.where(n_words > 0, np.maximum(n_words - window + 1, 1), 0)
            first, row = ranges(found.bounds[:-1], many), np.repeat(np.arange(len(many)), many)
            n = np.minimum(n_words, window)[row]
            size = np.minimum(n, shingle)
            data, at = spaced(found.flat)
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(at[first].tolist(), (at[first + n] - 1).tolist(), strict=True)]
            own = ranges(first, n - size + 1)
            sizes = np.repeat(size, n - size + 1)
            keys = mixed(found.hash(own, own + sizes), sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n - size + 1)]), pa.int32()), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column("item_id").take(pa.array(row)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int32()), lists], ["item_id", "w", "n", "keys"])

    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    return items.mapInArrow(run, "item_id string, w string, n int, keys array<long>")


class Bits:
    """A table of bits with two set for each of a set of keys: :meth:`maybe` is false for keys that are surely not in it."""

    def __init__(self, size: int, slices: dict[int, bytes]):
        self.size, self.table = size, np.zeros(size // 8, np.uint8)
        for k, data in slices.items():
            self.table[k * SLICE // 8 : (k + 1) * SLICE // 8] = np.frombuffer(data, np.uint8)

    @staticmethod
    def places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        most = np.uint64(size - 1)
        return (keys & most).astype(np.int64), ((keys >> np.uint64(32)) & most).astype(np.int64)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        a, b = self.places(keys, self.size)
        out = (self.table[a >> 3] >> (a & 7).astype(np.uint8)) & 1 == 1
        on = np.flatnonzero(out)
        out[on] = (self.table[b[on] >> 3] >> (b[on] & 7).astype(np.uint8)) & 1 == 1
        return out


def bits_of(keys: DataFrame, count: int) -> Bits:
    """The table of the distinct ``keys(h)``, put together in slices by tasks; only its slices come to the driver."""
    size = LEAST_BITS
    while size < min(MOST_BITS, BITS_EACH * count):
        size *= 2

    def merged(pieces: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for k, piece in pieces:
            own[k] = own[k] | piece if k in own else piece
        for k, piece in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([piece.tobytes()], pa.binary())], ["k", "piece"])

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                at = np.unique(np.concatenate(Bits.places(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64), size)))
                for k in np.unique(at // SLICE).tolist():
                    piece = np.zeros(SLICE, np.uint8)
                    piece[at[at // SLICE == k] % SLICE] = 1
                    yield k, np.packbits(piece, bitorder="little")

        yield from merged(pieces())

    def join_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merged((k, np.frombuffer(p.as_py(), np.uint8)) for b in batches for k, p in zip(b.column("k").to_pylist(), b.column("piece"), strict=True))

    schema = "k long, piece binary"
    rows = keys.mapInArrow(set_bits, schema).repartition("k").mapInArrow(join_bits, schema).collect()  # at most MOST_BITS / 8 bytes
    return Bits(size, {r.k: r.piece for r in rows})


def corpus_counts(docs: DataFrame, known: Bits, sizes: list[int]) -> DataFrame:
    """``h, n``: how often each shingle that may be an item's stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most=BLOCK_BYTES):
            found = Shingles(block.column("text"))
            for size in sizes:
                _, keys = found.all(size)
                own, n = np.unique(keys[shared.value.maybe(keys)], return_counts=True)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _proposed(docs: DataFrame, key: list[str], prefixes: Bits, sizes: list[int], window: int) -> DataFrame:
    """``row, key, n_words, found``: a row a document, and rows without ``n_words`` for candidates beyond the first chunk."""
    shared = docs.sparkSession.sparkContext.broadcast(prefixes)
    read = docs.select(F.struct(*key).alias("key"), "text")
    schema = f"row long, key {read.schema['key'].dataType.simpleString()}, n_words long, found array<struct<at:long,h:long,off:int,words:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for block in blocks(batches, most=BLOCK_BYTES):
            found = Shingles(block.column("text"))
            first, keys, size = [], [], []
            for s in sizes:
                at, own = found.all(s)
                on = np.flatnonzero(shared.value.maybe(own))
                for to, x in ((first, at[on]), (keys, own[on]), (size, np.full(len(on), s))):
                    to.append(x)
            first, keys, size = (np.concatenate(x) for x in (first, keys, size))
            row = np.searchsorted(found.bounds, first, "right") - 1
            order = np.argsort(row, kind="stable")
            first, keys, size, row = first[order], keys[order], size[order], row[order]
            low = np.maximum(found.bounds[row], first + size - window)
            high = np.minimum(found.bounds[row + 1], first + window)
            data, at = spaced(found.flat) if len(first) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
            raw = data.tobytes()
            ends = np.searchsorted(row, np.arange(block.num_rows + 1))
            # Chunks of candidates: the first of each text with its words, further ones without.
            chunks = np.maximum(1, -(-np.diff(ends) // _CHUNK))
            text = np.repeat(np.arange(block.num_rows), chunks)
            place = ranges(np.zeros(len(chunks), np.int64), chunks)
            begin = np.minimum(ends[text] + place * _CHUNK, ends[text + 1])
            cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(first) + 1, 16 * _CHUNK)), len(text)))
            for j, k in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # a bound on the words put around candidates at once
                own = slice(j, k)
                a, b = int(begin[j]), int(begin[k]) if k < len(text) else len(first)
                around = [raw[x:y] for x, y in zip(at[low[a:b]].tolist(), (at[high[a:b]] - 1).tolist(), strict=True)]
                entries = pa.StructArray.from_arrays([pa.array(first[a:b] - found.bounds[row[a:b]]), pa.array(keys[a:b].view(np.int64)), pa.array((first[a:b] - low[a:b]), pa.int32()), pa.array(around, pa.binary()).cast(pa.string())], ["at", "h", "off", "words"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin[own], b) - a, pa.int32()), entries)
                n_words = pa.array(np.diff(found.bounds)[text[own]], pa.int64(), mask=place[own] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(number + text[own]), block.column("key").take(pa.array(text[own])), n_words, lists], ["row", "key", "n_words", "found"])
            number += block.num_rows

    return read.mapInArrow(run, schema)


def _looked_up(left: DataFrame, right: DataFrame, on: str, by: list[str], how: str = "inner") -> DataFrame:
    """A join on one column that broadcasts ``right`` if it is small, and otherwise deals the rows of frequent keys."""
    if fits(right):
        return left.join(F.broadcast(right), on, how)
    counts = left.groupBy(on).agg(F.count("*").alias("n"))
    return spread_join(left, right, [on], counts, left.count(), by, how)


def contamination(docs: DataFrame, items: DataFrame, key: list[str], window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """For each row of ``docs``: the ``key`` columns and :data:`COLUMNS` (words, words hit, items hit, their digest)."""
    if clash := {k.lower() for k in key} & set(COLUMNS):
        raise ValueError(f"key columns named like a result: {sorted(clash)}")
    scratch: list[DataFrame] = []
    shingle = min(shingle, window)
    every = written(item_windows(items, window, shingle), "item-windows", scratch)
    distinct = written(every.groupBy("w").agg(F.any_value("n").alias("n"), F.any_value("keys").alias("keys")), "windows", scratch)
    sizes = sorted(min(r.n, shingle) for r in distinct.select("n").distinct().collect()) or [shingle]  # a row a length
    sizes = sorted(set(sizes))
    placed = distinct.select("w", "n", F.posexplode("keys").alias("place", "h"))
    shingles = written(placed.select("h").distinct(), "item-shingles", scratch)
    counts = written(corpus_counts(docs, bits_of(shingles, shingles.count()), sizes), "shingle-counts", scratch)
    rare = _looked_up(placed, counts.withColumnRenamed("n", "times"), "h", ["w"], "left")
    prefix = rare.groupBy("w", "n").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "h", "place")).alias("p"))
    prefix = written(prefix.where("p.times > 0").select("w", "n", "p.h", "p.place"), "window-prefixes")
    keys = prefix.select("h").distinct()
    rows = written(_proposed(docs, key, bits_of(keys, keys.count()), sizes, window), "proposed-windows")
    near = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    near = _looked_up(near, prefix, "h", ["row", "at"])
    # Positional and length bound, then the words themselves.
    around, begin = F.split("words", " "), F.col("off") - F.col("place")
    inside = (begin >= 0) & (begin + F.col("n") <= F.size(around))
    same = F.array_join(F.slice(around, F.greatest(begin, F.lit(0)) + 1, F.col("n")), " ") == F.col("w")
    hits = written(near.where(inside & same).select("row", (F.col("at") - F.col("place")).alias("start"), "n", "w").distinct(), "hits")
    order = Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    fresh = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(order), F.lit(0))), F.lit(0))
    hit_words = hits.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = _looked_up(hits.select("row", "w").distinct(), every.select("w", "item_id").distinct(), "w", ["row"])
    named = written(_digests(named.select("row", "item_id").distinct()), "hit-items")
    drop_all(scratch)
    zero = F.lit(0).cast("long")
    found = rows.where("n_words is not null").select("row", "key", "n_words").join(bounded(hit_words.join(named, "row")), "row", "left")
    return found.select(*(F.col(f"key.{k}").alias(k) for k in key), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.lit(_NONE)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def _digests(named: DataFrame) -> DataFrame:
    """``row, n_items, items_sha256`` of the distinct ``named(row, item_id)``; the ids stream through in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, n, out = None, None, 0, []
        for batch in batches:
            for row, item in zip(batch.column("row").to_pylist(), batch.column("item_id").to_pylist(), strict=True):
                if row != current:
                    out += [(current, n, digest.hexdigest())] if n else []
                    current, digest, n = row, hashlib.sha256(), 0
                digest.update((b"," if n else b"") + item.encode())
                n += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["row", "n_items", "items_sha256"])
                out = []
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([n]), pa.array([digest.hexdigest()])], ["row", "n_items", "items_sha256"])

    return named.repartition("row").sortWithinPartitions("row", "item_id").mapInArrow(run, "row long, n_items long, items_sha256 string")


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs(doc_id, text)`` in which no window occurs, with all their columns. Whether one does depends on the
    text alone, so rows are known by their id and a hash of their text; only the keys of what goes are joined to the texts."""
    on = spare(docs.columns, "_own_null", "_own_id", "_own_text")
    null_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    docs = docs.withColumns(dict(zip(on, (F.col("doc_id").isNull(), null_id, F.xxhash64("text")), strict=True)))
    gone = contamination(docs, items, on, window).where("contaminated").select(*on).distinct()
    return docs.join(bounded(written(gone, "contaminated")), on, "left_anti").drop(*on)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH item AS (
  SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i : i + least({WINDOW}, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - {WINDOW - 2}))) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, row_number() OVER () AS r, {_WORDS.format("text")} AS w FROM documents
), gram AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT r, i, win.n, item_id FROM gram JOIN win ON gram.n = win.n AND gram.s = win.s
), spot AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN spot USING (r) LEFT JOIN named USING (r)
"""
