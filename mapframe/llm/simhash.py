"""SimHash near-duplicates: every pair of fingerprints within a Hamming radius, as connected components.

Distances to reference fingerprints (pivots) bound the distance of a pair: ``|d(x, p) - d(y, p)| <= d(x, y)``. The table
of these distances discards a pair whose largest coordinate difference exceeds the radius; survivors are verified by
XOR and popcount. At a radius of 4 of 64 bits one pivot lets about half of all unrelated pairs pass, so pivots alone
cannot be joined on without looking at a constant share of all pairs. The pairs put to the table are therefore those
that agree exactly on some bits: of ``m`` bit blocks, two fingerprints within radius ``r`` agree on at least ``m - r``,
so each choice of ``m - r`` blocks is a key and no pair is missed. ``m`` grows with the number of distinct fingerprints
(:func:`bit_blocks`), which keeps the keys' groups of unrelated fingerprints small at every size.

Equal fingerprints are one node. A key with more than ``group`` fingerprints is split into cells of bounded size; a
task sends a spanning forest of the links it found, never all pairs of a group, and in a large cell it stops comparing
what is of one component already. The rows of a fingerprint or a component that many have are dealt to several tasks.

Defined results: null text counts as empty; texts without words have fingerprint zero and are linked with each other;
repeated rows and equal ids keep a row each; ``component_id`` ignores null ids and is null where a component has no
other; an empty table gives no row; columns other than the id and the text are not read, and :func:`one_of_each` keeps all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapframe.llm.common import WHITE, blocks, bounded, drop_all, drop_written, ranges, spaced, spare, spread_join, text_of, words, written
from mapframe.llm.components import components, local_labels
from mapframe.llm.hashing import xxh64

SEED = 42
WORDS, RADIUS = 4, 4
#: Fingerprints of one key that are compared as one group; keys with more are split into cells of two groups.
GROUP = 8192
#: The pivots: XXH64 of their numbers.
PIVOTS = xxh64(np.arange(16, dtype="<u8").view(np.uint8), np.arange(16) * 8, np.full(16, 8), SEED)
_SPREAD = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(256, 8, 1).repeat(8, 2) * np.array([1, 0, 0, 0, 0, 0, 0, 0], np.uint8), axis=2, bitorder="little").reshape(256, 8).copy().view("<u8")[:, 0]


def shingle_hashes(texts: pa.Array, shingle: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes of the shingles of all texts, how many each text has)``."""
    flat, bounds = words(text_of(texts), WHITE)
    n_words = np.diff(bounds)
    data, at = spaced(flat)  # a shingle is a slice
    many = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    first = ranges(bounds[:-1], many)
    last = first + np.repeat(np.minimum(n_words, shingle), many)
    return xxh64(data, at[first], at[last] - 1 - at[first], SEED), many


def fingerprints_of(texts: pa.Array, shingle: int = WORDS) -> np.ndarray:
    """The 64-bit fingerprint of each text, as uint64."""
    hashes, many = shingle_hashes(texts, shingle)
    out = np.zeros(len(texts), np.uint64)
    rows = np.flatnonzero(many)
    if len(rows):
        out[rows] = _majority(hashes, many[rows])
    return out


def _majority(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each run of ``many`` hashes the bits set in over half of them. Eight counters of 8 bits share a uint64, so runs
    are counted in pieces of at most 255."""
    pieces = -(-many // 255)
    starts = np.repeat(np.cumsum(many) - many, pieces) + 255 * ranges(np.zeros(len(many), np.int64), pieces)
    counts = np.zeros((len(starts), 64), np.int64)
    for k in range(8):
        packed = np.add.reduceat(_SPREAD[(hashes >> np.uint64(8 * k)).astype(np.uint8)], starts)
        counts[:, 8 * k : 8 * k + 8] = packed.view(np.uint8).reshape(-1, 8)
    totals = np.add.reduceat(counts, np.cumsum(pieces) - pieces, axis=0)
    return np.packbits(2 * totals > many[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, shingle: int = WORDS) -> DataFrame:
    """``doc_id, t, fp`` (long: the 64 bits); ``t`` is a hash of the text, which tells apart rows of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("t"), pa.array(fingerprints_of(block.column("text"), shingle).view(np.int64))], ["doc_id", "t", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t")).mapInArrow(run, "doc_id long, t long, fp long")


def bit_blocks(n: int, radius: int = RADIUS) -> int:
    """How many blocks the 64 bits are cut into, so that a key's group holds few unrelated fingerprints of ``n``."""
    agree = 1
    while agree < 4 and n > 1 << (20 + 6 * (agree - 1)):
        agree += 1
    return radius + agree


def keys(fp: Column, n: int, radius: int) -> Column:
    """An array of the keys of a fingerprint: for each choice of blocks, its number and the bits of those blocks."""
    m = bit_blocks(n, radius)
    edges = [64 * i // m for i in range(m + 1)]
    chosen = []
    for number, blocks_ in enumerate(combinations(range(m), m - radius)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in blocks_)
        chosen.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*chosen)


def links(fps: DataFrame, n: int, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """``u, v``: links that connect every two of the distinct ``fps(fp)`` within ``radius``, a spanning forest a task.

    Keys are hashed to 64 bits: two keys that fall together put more pairs to the test and hide none.
    """
    keyed = fps.select("fp", F.explode(keys(F.col("fp"), n, radius)).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > group).select("key", F.ceil(F.col("count") / group).cast("int").alias("parts"))
    keyed = keyed.join(large, "key", "left")
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = keyed.withColumn("part", F.coalesce(part, F.lit(0))).withColumn("other", other)
    cells = cells.select("fp", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(lambda batches: _found(batches, radius), "u long, v long")


def _found(batches: Iterator[pa.RecordBatch], radius: int, rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Links of whole cells, gathered until ``rows`` rows are there."""
    cells: list[np.ndarray] = []
    fps: list[np.ndarray] = []

    def flush(upto: int | None) -> Iterator[pa.RecordBatch]:
        nonlocal cells, fps
        cell, fp = np.concatenate(cells), np.concatenate(fps)
        u, v = _spanning(cell[:upto], fp[:upto], radius)
        cells, fps = ([cell[upto:]], [fp[upto:]]) if upto is not None else ([], [])
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cells.append(batch.column("cell").to_numpy())
        fps.append(batch.column("fp").to_numpy().view(np.uint64))
        held += batch.num_rows
        if held >= rows:
            last = np.concatenate(cells)
            upto = int(np.searchsorted(last, last[-1]))  # the last cell may go on
            if upto:
                yield from flush(upto)
                held -= upto
    if held:
        yield from flush(None)


#: Fingerprints of a cell from which on it is searched by :func:`_one_by_one`.
LARGE = 512


def _spanning(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints of equal cells."""
    table = np.stack([np.bitwise_count(fp ^ p) for p in PIVOTS], axis=1).astype(np.int8)
    order = np.lexsort((table[:, 0], cell))
    cell, fp, table = cell[order], fp[order], table[order]
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(cell)))
    nodes, node = np.unique(fp, return_inverse=True)
    small = np.repeat(sizes < LARGE, sizes)
    labels = _neighbours(np.repeat(np.arange(len(starts)), sizes)[small], fp[small], table[small], node[small], len(nodes), radius)
    for a, n in zip(starts[sizes >= LARGE].tolist(), sizes[sizes >= LARGE].tolist(), strict=True):
        x, y = _one_by_one(fp[a : a + n], table[a : a + n], radius)
        labels = local_labels(len(nodes), node[a + x], node[a + y], labels)
    linked = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[linked], nodes[labels[linked]]


def _neighbours(number: np.ndarray, fp: np.ndarray, table: np.ndarray, node: np.ndarray, n: int, radius: int, most: int = 1 << 20) -> np.ndarray:
    """Labels of the ``n`` nodes: the pairs of each cell whose distances to the first pivot are near, all cells at once."""
    place = number * 128 + table[:, 0]  # ascending; a partner stands at most ``radius`` further, in the same cell
    many = np.searchsorted(place, place + radius, "right") - np.arange(len(place)) - 1
    labels = np.arange(n)
    ends = np.cumsum(many)
    first = 0
    while first < len(place):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        a = np.repeat(np.arange(first, last), many[first:last])
        b = ranges(np.arange(first, last) + 1, many[first:last])
        open_ = labels[node[a]] != labels[node[b]]
        a, b = a[open_], b[open_]
        for k in range(1, table.shape[1]):
            near = np.abs(table[a, k] - table[b, k]) <= radius
            a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        labels = local_labels(n, node[a[near]], node[b[near]], labels)
        first = last
    return labels


def _one_by_one(fp: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect a large cell: one fingerprint is held against those of other components at a time, always one of
    the smallest component that has one left, until those left are of one component. A group of near copies costs one pass
    a fingerprint outside it."""
    labels, left = np.arange(len(fp)), np.ones(len(fp), bool)
    size = np.ones(len(fp), np.int64)  # fingerprints left, by label
    x, y = [], []
    while True:
        able = np.flatnonzero(size)
        if len(able) < 2:
            return np.array(x, np.int64), np.array(y, np.int64)
        own = int(able[np.argmin(size[able])])
        i = int(np.flatnonzero(left & (labels == own))[0])
        left[i], size[own] = False, size[own] - 1
        lo, hi = np.searchsorted(table[:, 0], [table[i, 0] - radius, table[i, 0] + radius + 1])
        near = lo + np.flatnonzero(left[lo:hi] & (labels[lo:hi] != own))
        for k in range(1, table.shape[1]):
            near = near[np.abs(table[near, k] - table[i, k]) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[i]) <= radius]
        for other in np.unique(labels[near]).tolist():
            x.append(i)
            y.append(int(near[labels[near] == other][0]))
            labels[labels == other] = own
            size[own], size[other] = size[own] + size[other], 0


def linked(docs: DataFrame, shingle: int = WORDS, radius: int = RADIUS, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """The :func:`fingerprints` of ``docs``, written, and ``fp, first, n, root``, written: smallest id, rows and component."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    return rows, _rooted(rows, lambda fps, _: links(fps.select("fp"), fps.count(), radius, group))


def _rooted(rows: DataFrame, found: Callable[[DataFrame, list[DataFrame]], DataFrame]) -> DataFrame:
    """``fp, first, n, root``, written. ``found`` gives the links of the distinct ``fp``; the tables that it writes on the
    way go to its second argument and are removed, like those made here."""
    scratch: list[DataFrame] = []
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints", scratch)
    named = components(found(fps, scratch), scratch).withColumnRenamed("node", "fp")
    rooted = written(fps.join(named, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "rooted-fingerprints")
    drop_all(scratch)
    return rooted


def near_duplicates(docs: DataFrame, shingle: int = WORDS, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs(doc_id, text)``."""
    rows, rooted = linked(docs, shingle, radius, group)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = spread_join(rooted.select("fp", "root"), smallest.drop("n"), ["root"], smallest.select("root", "n"), rooted.count(), ["fp"])
    return spread_join(rows, named.select("fp", "component_id"), ["fp"], rooted.select("fp", "n"), rows.count(), ["doc_id", "t"]).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = WORDS, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (a null id last), of those that of the smallest
    hash of its text, and of rows equal in both any one."""
    rows, rooted = linked(docs, shingle, radius, group)
    out = first_of_each(docs, rows, rooted)
    drop_all([rows, rooted])
    return out


def first_of_each(docs: DataFrame, rows: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`one_of_each` keeps, by ``rows(doc_id, t, fp)`` and ``rooted(fp, n, root)``. Only the
    keys of what goes are joined to the texts; the result reads neither ``rows`` nor ``rooted``."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t")
    total = rows.count()
    keyed = spread_join(rows, rooted.select("fp", "root"), ["fp"], rooted.select("fp", "n"), total, ["doc_id", "t"]).select("root", order.alias("o"))
    keyed = written(keyed.groupBy("root", "o").agg(F.count("*").alias("copies")), "near-members")
    first = keyed.groupBy("root").agg(F.min("o").alias("first"), F.count("*").alias("n"))
    keys = spread_join(keyed, first.drop("n"), ["root"], first.select("root", "n"), total, ["o"])
    keys = written(keys.select("o.*", (F.col("o") == F.col("first")).alias("stays"), "copies"), "near-duplicates")
    drop_written(keyed)
    null_id, own_t = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64("text")
    on = spare(docs.columns, "_near_n", "_near_d", "_near_t")
    docs = docs.withColumns(dict(zip(on, (F.col("doc_id").isNull(), null_id, own_t), strict=True)))
    named = keys.select(F.col("n").alias(on[0]), F.coalesce("doc_id", F.lit(0)).alias(on[1]), F.col("t").alias(on[2]), "stays", "copies")
    out = docs.join(bounded(named.where("not stays").select(*on)), on, "left_anti")
    repeated = named.where("stays and copies > 1").select(*on)
    if not repeated.isEmpty():
        alone = out.join(bounded(repeated), on, "left_anti")
        out = alone.unionByName(out.join(bounded(repeated), on, "left_semi").dropDuplicates(on))
    return out.drop(*on)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
