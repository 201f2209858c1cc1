"""Near copies by Jaccard similarity: every two documents whose sets of word shingles have a similarity of 4/5 or more,
found by SimHash fingerprints and verified on the sets.

A fingerprint has 192 bits, each set if it is set in over half of a set's shingle hashes; the first 64 are those of
:mod:`mapframe.llm.simhash` for a set, the others come from the same hashes mixed anew. Two sets of similarity 4/5 differ
in about 15 % of the bits (29, standard deviation 5), unrelated ones in half. As there, pairs that agree on a key of bits
are put to a table of distances to pivots, then to XOR and popcount, with a radius of 60. No number of bit blocks is
searched whole at that radius, so a key is a choice of bits, and there are so many keys (:func:`masks`) that a pair
that differs in 15 % of the bits shares 24 in the mean. Some pairs differ in more: of 20,000 pairs of random sets at a
similarity of 4/5 one at most is missed with 200,000 sets; with 12 million, 37 if they have five and four shingles, two at
most if larger.
Only sets whose sizes differ by at most a quarter are compared, which loses no pair.

The components of these links hold unrelated and looser pairs too, so each is counted exactly on the sets of shingle hashes
(64 bits), and what is linked is never an estimate. Equal sets are one node. The sets of a component meet in one cell; one
that holds more than ``most`` shingles is split into cells of two parts. In a cell one set is counted against all
others at a time, always one of the smallest group not yet done, until those left are of one component: near copies of
one text cost one count, however many they are.

Defined results: as in :mod:`mapframe.llm.simhash`; texts of fewer than five words have one shingle, all their words, and
texts without words are linked with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapframe.llm.common import blocks, bounded, drop_all, give_back, ranges, written
from mapframe.llm.components import components, local_labels
from mapframe.llm.simhash import GROUP, PIVOTS, _majority, _rooted, first_of_each, shingle_hashes

WORDS = 5
#: 64-bit words of a fingerprint, and in how many bits two may differ whose sets are compared.
WIDE, RADIUS = 3, 60
#: Fingerprints, about, that share a key; keys that a pair at 15.15 % of the bits shares in the mean.
ROOM, SHARED = 1 << 10, 24
#: Shingles of one part of a component (8 bytes each).
MOST = 2 << 20
#: Fingerprints of a cell from which on it is searched by :func:`_one_by_one`.
LARGE = 4096
_WORDS = [f"s{k}" for k in range(WIDE)]
_SALTS = [np.uint64(0), *PIVOTS[: WIDE - 1]]
_PIVOTS = PIVOTS[: 2 * WIDE].reshape(2, WIDE)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, shingle: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: the distinct shingle hashes of each text, ascending."""
    hashes, many = shingle_hashes(texts, shingle)
    row = np.repeat(np.arange(len(many)), many)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    own = np.ones(len(hashes), bool)
    own[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[own], np.concatenate([[0], np.cumsum(np.bincount(row[own], minlength=len(many)))])


def nodes_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    out, rows = np.zeros(len(bounds) - 1, np.uint64), np.flatnonzero(np.diff(bounds))
    if len(rows):
        out[rows] = _mixed(np.add.reduceat(_mixed(hashes), bounds[rows]))
    return out


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The fingerprint of each set, one row a set."""
    out, many = np.zeros((len(bounds) - 1, WIDE), np.uint64), np.diff(bounds)
    rows = np.flatnonzero(many)
    if len(rows):
        for k, salt in enumerate(_SALTS):
            out[rows, k] = _majority(_mixed(hashes ^ salt) if k else hashes, many[rows])
    return out


def masks(n: int) -> np.ndarray:
    """The bits of each key, one row a key, for ``n`` fingerprints. Keys of one permutation of the bits share none."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / ROOM)))
    if not bits:
        return np.zeros((1, WIDE), np.uint64)
    rng, chosen = np.random.default_rng(42), np.zeros((math.ceil(SHARED / 0.8485**bits), 64 * WIDE), np.uint8)
    each = 64 * WIDE // bits
    for k in range(0, len(chosen), each):
        order = rng.permutation(64 * WIDE)
        for row, own in zip(chosen[k : k + each], order[: each * bits].reshape(each, bits)):
            row[own] = 1
    return np.packbits(chosen, axis=1, bitorder="little").view("<u8")


def _rows(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, t, fp, n, s0, s1, s2``: the node of each document, the size of its set and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most=1 << 20):
            hashes, bounds = shingle_sets(block.column("text"), shingle)
            words = [pa.array(np.ascontiguousarray(s).view(np.int64)) for s in signatures(hashes, bounds).T]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("t"), pa.array(nodes_of(hashes, bounds).view(np.int64)), pa.array(np.diff(bounds)), *words], ["doc_id", "t", "fp", "n", *_WORDS])

    schema = "doc_id long, t long, fp long, n long, " + ", ".join(f"{s} long" for s in _WORDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t")).mapInArrow(run, schema)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``fp, s``: the node and the set, 8 bytes a shingle, of ``texts(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most=1 << 20):
            hashes, bounds = shingle_sets(block.column("text"), shingle)
            sets = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes_of(hashes, bounds).view(np.int64)), pa.array(sets, pa.binary())], ["fp", "s"])

    return texts.select("text").mapInArrow(run, "fp long, s binary")


def spanning(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``sets`` with a similarity of 4/5 or more, as pairs of positions."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if 9 * shared >= 4 * size.sum() else []
    owner = np.repeat(np.arange(len(sets)), size)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    postings = owner[np.argsort(codes, kind="stable")]
    ends = np.cumsum(np.bincount(codes))
    starts, bounds = np.concatenate([[0], ends[:-1]]), np.concatenate([[0], np.cumsum(size)])
    labels, left, out = np.arange(len(sets)), np.ones(len(sets), bool), []
    while True:
        groups = np.bincount(labels[left], minlength=len(sets))
        if np.count_nonzero(groups) < 2:
            return out
        smallest = int(np.argmin(np.where(groups > 0, groups, len(sets) + 1)))
        i = int(np.flatnonzero(left & (labels == smallest))[0])
        left[i] = False
        shared = np.zeros(len(sets), np.int64)
        for code in codes[bounds[i] : bounds[i + 1]]:
            shared[postings[starts[code] : ends[code]]] += 1
        for j in np.flatnonzero(left & (labels != labels[i]) & (9 * shared >= 4 * (size + size[i]))):
            if labels[j] != labels[i]:
                out.append((i, int(j)))
                labels[labels == labels[j]] = labels[i]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the cells, which come one after the other."""
    current, nodes, sets = None, [], []

    def links() -> Iterator[pa.RecordBatch]:
        pairs = spanning(sets) if len(sets) > 1 else []
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k, _ in pairs], pa.int64()), pa.array([nodes[k] for _, k in pairs], pa.int64())], ["u", "v"])

    for batch in batches:
        for cell, node, s in zip(batch.column("cell").to_pylist(), batch.column("fp").to_pylist(), batch.column("s"), strict=True):
            if cell != current:
                yield from links()
                current, nodes, sets = cell, [], []
            nodes.append(node)
            sets.append(np.frombuffer(s.as_py(), np.uint64))
    yield from links()
    sets.clear()
    give_back()


def _apart(s: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs ``a, b`` within ``radius``: the table of pivots discards, XOR and popcount verify."""
    for d in table:
        near = np.abs(d[a] - d[b]) <= radius
        if not near.all():
            a, b = a[near], b[near]
    many = np.bitwise_count(s[0, a] ^ s[0, b])
    for word in s[1:]:
        many += np.bitwise_count(word[a] ^ word[b])
    near = many <= radius
    return a[near], b[near]


def _forest(cell: np.ndarray, fp: np.ndarray, size: np.ndarray, s: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints ``s`` (a row a word) of equal cells whose sets are of like size."""
    order = np.lexsort((size, cell))
    cell, fp, size, s = cell[order], fp[order], size[order], s[:, order]
    table = np.stack([sum(np.bitwise_count(word ^ x).astype(np.int16) for word, x in zip(s, p, strict=True)) for p in _PIVOTS])
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, len(cell)))
    nodes, node = np.unique(fp, return_inverse=True)
    labels = np.arange(len(nodes))
    for a, n in zip(starts[sizes >= LARGE].tolist(), sizes[sizes >= LARGE].tolist(), strict=True):
        x, y = _one_by_one(size[a : a + n], s[:, a : a + n], table[:, a : a + n], radius)
        labels = local_labels(len(nodes), node[a + x], node[a + y], labels)
    number = np.repeat(np.arange(len(starts)), sizes) << 40
    many = np.searchsorted(number + size, number + 5 * size // 4, "right") - np.arange(len(cell)) - 1
    many[np.repeat(sizes >= LARGE, sizes)] = 0
    ends, first = np.cumsum(many), 0
    while first < len(cell):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + (1 << 18), "right")))
        a = np.repeat(np.arange(first, last), many[first:last])
        b = ranges(np.arange(first, last) + 1, many[first:last])
        open_ = labels[node[a]] != labels[node[b]]
        a, b = _apart(s, table, a[open_], b[open_], radius)
        labels = local_labels(len(nodes), node[a], node[b], labels)
        first = last
    linked = np.flatnonzero(labels != np.arange(len(nodes)))
    return nodes[linked], nodes[labels[linked]]


def _one_by_one(size: np.ndarray, s: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`mapframe.llm.simhash._one_by_one`, for fingerprints in the order of the sizes of their sets."""
    labels, left, held = np.arange(len(size)), np.ones(len(size), bool), np.ones(len(size), np.int64)
    x, y = [], []
    while True:
        able = np.flatnonzero(held)
        if len(able) < 2:
            return np.array(x, np.int64), np.array(y, np.int64)
        own = int(able[np.argmin(held[able])])
        i = int(np.flatnonzero(left & (labels == own))[0])
        left[i], held[own] = False, held[own] - 1
        lo, hi = np.searchsorted(size, [-(-4 * size[i] // 5), 5 * size[i] // 4 + 1])
        near = lo + np.flatnonzero(left[lo:hi] & (labels[lo:hi] != own))
        near = _apart(s, table, np.full(len(near), i), near, radius)[1]
        for other in np.unique(labels[near]).tolist():
            x.append(i)
            y.append(int(near[labels[near] == other][0]))
            labels[labels == other] = own
            held[own], held[other] = held[own] + held[other], 0


def _proposed(batches: Iterator[pa.RecordBatch], radius: int, rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Links of whole cells, which come one after the other, gathered until ``rows`` rows are there."""
    held: list[np.ndarray] = []

    def flush(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v = _forest(table[0], table[1], table[2], table[3:].view(np.uint64), radius)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns]))
        if sum(x.shape[1] for x in held) >= rows:
            table = np.concatenate(held, axis=1)
            upto = int(np.searchsorted(table[0], table[0, -1]))  # the last cell may go on
            if upto:
                yield from flush(np.ascontiguousarray(table[:, :upto]))
            held = [table[:, upto:].copy()]
    if held:
        yield from flush(np.concatenate(held, axis=1))
    give_back()


def within_radius(fps: DataFrame, n: int, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """``u, v``: links that connect those of the ``n`` distinct ``fps(fp, n, s0, s1, s2)`` that share a key and lie within
    ``radius``, a spanning forest a task. A key with more than ``group`` fingerprints is split into cells of two parts."""
    spark = fps.sparkSession
    bits = [f"m{k}" for k in range(WIDE)]
    chosen = spark.createDataFrame([(k, *row) for k, row in enumerate(masks(n).view(np.int64).tolist())], "number int, " + ", ".join(f"{m} long" for m in bits))
    key = F.xxhash64("number", *(F.col(s).bitwiseAND(F.col(m)) for s, m in zip(_WORDS, bits, strict=True)))
    keyed = fps.crossJoin(F.broadcast(chosen)).select(key.alias("key"), "fp", "n", *_WORDS)
    large = keyed.groupBy("key").count().where(F.col("count") > group).select("key", F.ceil(F.col("count") / group).cast("int").alias("parts"))
    keyed = keyed.join(bounded(large), "key", "left")
    part = F.coalesce(F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int"), F.lit(0))
    cells = keyed.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    cell = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    cells = cells.select(cell.alias("cell"), "fp", "n", *_WORDS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(lambda batches: _proposed(batches, radius), "u long, v long")


def links(docs: DataFrame, rows: DataFrame, scratch: list[DataFrame], shingle: int = WORDS, most: int = MOST, radius: int = RADIUS) -> DataFrame:
    """``u, v``: links that connect every two similar nodes of ``rows``, which are the :func:`_rows` of ``docs``. The tables
    that the result reads are added to ``scratch``."""
    place = F.struct(F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0)).alias("d"), "t")
    nodes = rows.groupBy("fp").agg(F.any_value(F.struct("n", *_WORDS)).alias("s"), F.min(place).alias("at")).select("fp", "s.*", "at")
    nodes = written(nodes, "near-nodes", scratch)
    found = components(within_radius(nodes.drop("at"), nodes.count(), radius), scratch).select(F.col("node").alias("fp"), F.col("root").alias("key"))
    keyed = written(nodes.select("fp", "n", "at").join(bounded(found), "fp"), "near-keyed", scratch)
    shared = keyed.groupBy("key").agg(F.ceil(F.sum("n") / most).cast("int").alias("parts")).where("parts > 1")
    able = written(keyed.join(bounded(shared), "key", "left").select("fp", "at", "key", F.coalesce("parts", F.lit(1)).alias("parts")), "near-able", scratch)
    reps = able.select("at.*").toDF("_null", "_d", "_t")
    named = docs.select("text", F.col("doc_id").isNull().alias("_null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_d"), F.xxhash64("text").alias("_t"))
    sets = _sets(named.join(bounded(reps), ["_null", "_d", "_t"], "left_semi"), shingle).dropDuplicates(["fp"])
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")).otherwise(0)
    cells = able.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("fp", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell")).join(sets, "fp")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_found, "u long, v long")


def one_of_each(docs: DataFrame, shingle: int = WORDS, most: int = MOST, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component of near copies, chosen as by :func:`mapframe.llm.simhash.one_of_each`."""
    rows = written(_rows(docs, shingle), "near-rows")
    rooted = _rooted(rows, lambda _, scratch: links(docs, rows, scratch, shingle, most, radius))
    out = first_of_each(docs, rows.select("doc_id", "t", "fp"), rooted)
    drop_all([rows, rooted])
    return out
