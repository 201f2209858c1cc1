"""Line deduplication within one edit, by a deletion-neighbourhood join.

A line is a sequence of words; an edit inserts, deletes or replaces one word, and the bound is ``edits``, 0 or 1. Of equal
lines of any positive number of words, and of lines of at least ``near`` words that are at most ``edits`` apart, the
earliest, by doc_id and then by place, is kept. In a shorter line one word is more than a fifth: any two lines of one word
would be one edit apart. Lines without words always stay; white space around and between words does not count.

Equal lines are joined first, by 128 bits of SHA-256 over their words, so that a line that stands in a third of all
documents is one node. Two lines one edit apart are equal after deleting at most one word from each. So every line emits
hashed keys of itself and of all its variants with one word deleted, and equal keys are joined:

* one word replaced: both emit the same rest with the same place deleted. All lines of such a key are one edit apart
  from each other, so the earliest of them stands for the whole key and no pairs are listed;
* one word inserted: a variant of the longer line equals the shorter line, which each key has once.

Every joined pair is then verified on its words. Lines that fail, because the keys of different rests were equal, are
joined again among themselves until none fails, so that no link depends on the hash. Variants are worth emitting only for
lines that can have a partner: one edit leaves the first or the last half of a pair unchanged (halves of a length that
both know: that of the longer line), so lines none of whose halves occurs in another line are left out first, by counting
four hashed halves a line. A line is dropped if an equal or verified line stands earlier, whether or not that one is
dropped itself.

Keys are counted before they are joined, and the rows of a key with many are dealt to several tasks.

Defined results: a null text stays null and has no lines; an empty text has one empty line; rows equal in id and text
are the same place and treated alike; a null id is the earliest; an empty table gives no row; other columns pass through,
but for columns named ``n_lines`` or ``dropped``, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapframe.llm.common import WHITE, blocks, bounded, bytes_of, drop_all, fits, offsets_of, ranges, spaced, spare, spread_join, text_of, word_spans, written
from mapframe.llm.hashing import RangeHashes, mixed

#: Words of a line from which on it is compared within one edit.
NEAR_WORDS = 5
EDITS = 1


class Lines:
    """The lines of a block of texts that have at least ``least`` words, with hashes of any range of their words.

    Hashes of ranges propose partners; only :meth:`digests` identify a line.
    """

    def __init__(self, texts: pa.Array, least: int = 1):
        texts = text_of(texts)
        data, bounds = bytes_of(texts), offsets_of(texts)
        separator = np.zeros(256, bool)
        separator[np.frombuffer(WHITE, np.uint8)] = True
        start, end = word_spans(np.where(separator[data], np.uint8(32), np.uint8(33)), bounds)
        text = np.searchsorted(bounds, start, "right") - 1
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        line = breaks[start] - breaks[bounds[:-1]][text] if len(start) else np.zeros(0, np.int64)
        change = np.flatnonzero((np.diff(text) != 0) | (np.diff(line) != 0)) + 1
        first = np.concatenate([[0], change]) if len(start) else np.zeros(0, np.int64)
        last = np.concatenate([change, [len(start)]]) if len(start) else np.zeros(0, np.int64)
        long = last - first >= least
        self.first, self.last = first[long], last[long]
        self.text, self.line = text[self.first], line[self.first]
        n = len(start)
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        self.words = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data[~separator[data]]))
        self.hash = RangeHashes(self.words)

    def digests(self) -> np.ndarray:
        """Two longs a line: 128 bits of SHA-256 of its words, each followed by a space."""
        data, at = spaced(self.words)
        raw = memoryview(data).cast("B")
        joined = b"".join([hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(at[self.first].tolist(), at[self.last].tolist(), strict=True)])
        return np.frombuffer(joined, "<i8").reshape(-1, 2)

    def halves(self) -> list[np.ndarray]:
        """Four keys a line: its first and last half, as one of a pair whose longer line has n or n + 1 words."""
        out, n = [], self.last - self.first
        for m in (n, n + 1):
            a = (m - 1) // 2
            out.append(mixed(self.hash(self.first, self.first + a), 2 * m))
            out.append(mixed(self.hash(self.last - (m - 1 - a), self.last), 2 * m + 1))
        return out

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(line number, place of the deleted word or -1, key)``: the line itself and each deletion."""
        n = self.last - self.first
        row = np.repeat(np.arange(len(n)), n + 1)
        place = ranges(np.full(len(n), -1), n + 1)
        a, p, b = self.first[row], self.first[row] + place, self.last[row]
        deleted = self.hash.without(a, np.maximum(p, a), b)
        return row, place, mixed(np.where(place < 0, self.hash(a, b), deleted), np.where(place < 0, n[row], n[row] - 1))


def _occurrences(keyed: DataFrame, near: int) -> DataFrame:
    """``h1, h2, d, t, line`` of each line with words, and the keys of its halves, null for lines of fewer than ``near``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most=2 << 20):
            lines = Lines(block.column("text"))
            digests, row, short = lines.digests(), pa.array(lines.text), lines.last - lines.first < near
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.ascontiguousarray(digests[:, k])) for k in (0, 1)), block.column("d").take(row), block.column("t").take(row), pa.array(lines.line), *(pa.array(x.view(np.int64), mask=short) for x in lines.halves())],
                ["h1", "h2", "d", "t", "line", "k1", "k2", "k3", "k4"],
            )

    return keyed.mapInArrow(run, "h1 long, h2 long, d long, t long, line long, k1 long, k2 long, k3 long, k4 long")


def _variants(texts: DataFrame) -> DataFrame:
    """``d, t, line, place, key`` of the variants of each line of ``texts(d, t, line, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, most=1 << 20):
            lines = Lines(block.column("text"))
            row, place, key = lines.variants()
            own = pa.array(lines.text[row])
            yield pa.RecordBatch.from_arrays([*(block.column(c).take(own) for c in ("d", "t", "line")), pa.array(place), pa.array(key.view(np.int64))], ["d", "t", "line", "place", "key"])

    return texts.mapInArrow(run, "d long, t long, line long, place long, key long")


def _earliest(deleted: DataFrame, scratch: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(pairs, best)``: the earliest ``e`` of each key and place with each other line ``o`` of it; ``key, place, e, n``."""
    best = written(deleted.groupBy("key", "place").agg(F.min("o").alias("e"), F.count("*").alias("n")).where("n > 1"), "line-keys", scratch)
    total = best.agg(F.sum("n")).first()[0] or 0
    joined = spread_join(deleted, best.drop("n"), ["key", "place"], best.select("key", "place", "n"), total, ["o"])
    return joined.where("e < o").select("o", "e", F.col("place").alias("po"), F.col("place").alias("pe"), "key", "place"), best


def _near(keyed: DataFrame, distinct: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """``d, t, line`` of the distinct lines that have a verified partner standing earlier."""
    halves = distinct.where("k1 is not null").select("first", F.explode(F.array("k1", "k2", "k3", "k4")).alias("k"))
    shared = written(halves.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "line-halves", scratch)
    total = shared.agg(F.sum("n")).first()[0] or 0
    keys = shared.select("k")
    able = halves.join(F.broadcast(keys), "k", "left_semi") if fits(keys) else spread_join(halves, keys, ["k"], shared, total, ["first"], "left_semi")
    able = written(able.select("first.*").distinct(), "line-partners", scratch)
    split = keyed.where("text is not null").select("d", "t", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    place = ["d", "t", "line"]
    texts = split.withColumn("line", F.col("line").cast("long")).join(bounded(able), place, "left_semi").dropDuplicates(place)
    texts = written(texts, "line-texts", scratch)
    variants = written(_variants(texts), "line-variants", scratch)
    own = F.struct(*place)
    deleted = variants.where("place >= 0").select("key", "place", own.alias("o"))
    whole = variants.where("place < 0").select("key", own.alias("s"))
    # One word replaced: the earliest of a key and place stands for all of them.
    pairs, best = _earliest(deleted, scratch)
    # One word inserted: the later of the longer and the shorter line has the other as its partner.
    often = best.groupBy("key").agg(F.sum("n").alias("n"))
    inserted = spread_join(deleted, whole, ["key"], often, best.agg(F.sum("n")).first()[0] or 0, ["o"]).where("o <> s")
    none = lambda t: F.lit(None).cast(t)
    inserted = inserted.select(F.greatest("o", "s").alias("o"), F.least("o", "s").alias("e"), F.when(F.col("o") > F.col("s"), F.col("place")).alias("po"), F.when(F.col("o") < F.col("s"), F.col("place")).alias("pe"), none("long").alias("key"), none("long").alias("place"))
    pairs = pairs.unionByName(inserted)
    listed = texts.select(own.alias("o"), F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "").alias("w"))
    rest = lambda w, p: F.when(p.isNull(), w).otherwise(F.filter(w, lambda _, i: i != p))
    found = None
    while True:
        pairs = written(pairs, "line-pairs", scratch)
        sides = pairs.join(listed, "o").withColumnRenamed("w", "wo")
        sides = spread_join(sides, listed.select(F.col("o").alias("e"), F.col("w").alias("we")), ["e"], pairs.groupBy("e").agg(F.count("*").alias("n")), pairs.count(), ["o"])
        same = rest(F.col("wo"), F.col("po")) == rest(F.col("we"), F.col("pe"))
        checked = written(sides.select("o", "key", "place", same.alias("same")), "line-checked", scratch)
        right = checked.where("same").select("o.*")
        found = right if found is None else found.unionByName(right)
        failed = checked.where("not same and key is not null").select("key", "place", "o")
        if failed.isEmpty():
            return found.distinct()
        pairs, _ = _earliest(failed, scratch)


def dedup_lines(docs: DataFrame, near: int = NEAR_WORDS, edits: int = EDITS) -> DataFrame:
    """``docs`` with the text that remains, and with ``n_lines`` and ``dropped`` (numbers of the dropped lines, from 0)."""
    if edits not in (0, 1):
        raise ValueError("edits is 0 or 1: the variants of a line grow as its length to the power of the bound")
    scratch: list[DataFrame] = []
    own_d, own_t, own_lines, own_dropped = spare(docs.columns, "_d", "_t", "_lines", "_dropped")
    docs = docs.withColumns({own_d: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), own_t: F.xxhash64("text")})
    keyed = docs.select(F.col(own_d).alias("d"), F.col(own_t).alias("t"), "text")
    seen = written(_occurrences(keyed, near), "lines", scratch)
    first = F.min(F.struct("d", "t", "line")).alias("first")
    distinct = written(seen.groupBy("h1", "h2").agg(first, F.count("*").alias("n"), *(F.min(k).alias(k) for k in ("k1", "k2", "k3", "k4"))), "distinct-lines", scratch)
    often = distinct.where("n > 1").select("h1", "h2", "first", "n")
    later = spread_join(seen.select("h1", "h2", "d", "t", "line"), often.drop("n"), ["h1", "h2"], often.drop("first"), seen.count(), ["d", "t", "line"])
    gone = later.where(F.struct("d", "t", "line") != F.col("first")).select("d", "t", "line")
    gone = gone.unionByName(_near(keyed, distinct, scratch)) if edits else gone
    gone = written(gone.groupBy("d", "t").agg(F.sort_array(F.collect_set("line")).alias("dropped")), "dropped-lines")
    drop_all(scratch)
    out = docs.join(bounded(gone.toDF(own_d, own_t, own_dropped)), [own_d, own_t], "left")
    lines = F.col(own_lines)
    dropped = F.coalesce(own_dropped, F.array().cast("array<bigint>"))
    kept = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), dropped)
    out = out.withColumn(own_lines, F.split("text", "\n")).withColumns({
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
        "dropped": dropped,
        "text": F.when(F.size(dropped) == 0, F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(lines, (i + 1).cast("int"))), "\n")),
    })
    return out.drop(own_d, own_t, own_dropped, own_lines)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, lines and dropped lines of each document, the numbers of the dropped ones, digest of what remains."""
    done = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_TOKENS = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH l AS (
  SELECT d.doc_id, d.line - 1 AS line, d.ls[d.line] AS raw, {_TOKENS.format("d.ls[d.line]")} AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)) d
), u AS (
  SELECT w, len(w) AS n, min({{'d': doc_id, 'l': line}}) AS o FROM l WHERE len(w) > 0 GROUP BY w
), k AS (
  SELECT w, n, o, m, side, CASE WHEN side = 0 THEN w[1 : (m - 1) // 2] ELSE w[n - (m - 1 - (m - 1) // 2) + 1 : n] END AS part
  FROM (SELECT w, n, o, unnest([n, n, n + 1, n + 1]) AS m, unnest([0, 1, 0, 1]) AS side FROM u WHERE n >= {NEAR_WORDS})
), p AS (
  SELECT DISTINCT b.w FROM k a JOIN k b ON a.m = b.m AND a.side = b.side AND a.part = b.part AND a.o < b.o
  WHERE (a.n = b.n AND len(list_filter(range(1, a.n + 1), lambda i: a.w[i] <> b.w[i])) = 1)
     OR (a.n = b.n + 1 AND len(list_filter(range(1, a.n + 1), lambda i: a.w[1 : i - 1] = b.w[1 : i - 1] AND a.w[i + 1 : a.n] = b.w[i : b.n])) > 0)
     OR (b.n = a.n + 1 AND len(list_filter(range(1, b.n + 1), lambda i: b.w[1 : i - 1] = a.w[1 : i - 1] AND b.w[i + 1 : b.n] = a.w[i : a.n])) > 0)
), f AS (
  SELECT l.doc_id, l.line, l.raw, u.w IS NOT NULL AND ({{'d': l.doc_id, 'l': l.line}} <> u.o OR p.w IS NOT NULL) AS gone
  FROM l LEFT JOIN u ON l.w = u.w LEFT JOIN p ON l.w = p.w
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (gone), '') AS dropped_lines,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
