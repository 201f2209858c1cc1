"""Exact top-k by inner product: a ball tree a shard, searched by branch and bound.

Vectors are scaled and floored to integers, so scores are exact integers and ties are real. A shard, the rows a task
reads in pieces of bounded size, becomes a ball tree. For a block of queries the search opens nodes in the order of the
largest upper bound ``<q, centre> + |q| * radius`` among the queries for which the node can still matter, and a node is
closed for each query whose current kth score its bound does not reach. The kth scores are shared: a first look at a
bounded sample gives every query a start; a first round over a sixteenth of the vectors raises it, and all tasks begin
the second round, over the others, with what the first one reached; a task carries the scores from shard to shard. A
start is a score that k candidates reach, so nothing of the answer is lost.

Queries are taken in blocks of ``query_block`` rows, and of 64 MB, against all vectors, one block after the other: the
driver holds one block, and the block's result is written before the next begins. So what is broadcast and what a task
holds is bounded by the block, whatever the number of queries.

Defined results: vectors that are null, or hold components that are null, not finite or not finite once they are scaled,
and rows without an id take no part.
Vectors of different lengths are not compared. A query's own row, known by its id, is no candidate. Repeated rows are
candidates each and queries each, with an answer for each. Scores beyond 64 bits are clamped to the range of a long. An empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapframe.llm.common import drop_written, fresh_path, written

SCALE = 256
#: Vectors of a shard at most, queries of a block at most, vectors of the sample that gives the first kth scores.
SHARD, QUERY_BLOCK, SAMPLE = 32_768, 16_384, 2_048
#: Bytes of the queries of a block.
BLOCK_BYTES = 64 << 20
_LEAF = 256
_LONG = 2**63 - 1


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """``(rows that take part, floor(scale * x) of each)``, as float64 that holds integers (object where it cannot)."""
    rows, out = [], []
    if len(column) and not column.null_count and not column.flatten().null_count:
        lengths = np.diff(np.asarray(column.offsets))
        if (lengths == lengths[0]).all():  # the usual case, without a loop
            with np.errstate(over="ignore"):
                matrix = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), lengths[0]) * scale)
            good = np.isfinite(matrix).all(axis=1)
            return np.flatnonzero(good), list(matrix[good])
    for k, vector in enumerate(column):
        if not vector.is_valid:
            continue
        values = vector.values
        if values.null_count:
            continue
        with np.errstate(over="ignore"):
            x = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        if np.isfinite(x).all():
            rows.append(k)
            out.append(x)
    return np.array(rows, np.int64), out


class BallTree:
    """Nodes over a reordered matrix: rows ``lo:hi``, centre, radius, children (-1: a leaf)."""

    def __init__(self, points: np.ndarray, leaf: int = _LEAF):
        self.order = np.arange(len(points))
        self.lo, self.hi, self.left, self.right = [], [], [], []
        centres, radii = [], []
        todo = [(0, len(points), -1, False)]
        while todo:
            lo, hi, parent, is_right = todo.pop()
            node = len(self.lo)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            own = points[self.order[lo:hi]]
            centre = own.mean(axis=0) if len(own) else np.zeros(points.shape[1])
            distance = np.sqrt(((own - centre) ** 2).sum(axis=1))
            for to, x in ((self.lo, lo), (self.hi, hi), (self.left, -1), (self.right, -1), (centres, centre), (radii, float(distance.max(initial=0)))):
                to.append(x)
            if hi - lo <= leaf or radii[-1] == 0:
                continue
            # Between two far points, each point to the nearer one; at the median if that leaves one side nearly empty.
            far = own[int(distance.argmax())]
            other = own[int(((own - far) ** 2).sum(axis=1).argmax())]
            along = own @ (other - far)
            near = along < (far + other) @ (other - far) / 2
            middle = int(near.sum())
            if not (hi - lo) // 20 <= middle <= hi - lo - (hi - lo) // 20 or middle in (0, hi - lo):
                middle = (hi - lo) // 2
                near = np.zeros(hi - lo, bool)
                near[np.argpartition(along, middle)[:middle]] = True
            self.order[lo:hi] = np.concatenate([self.order[lo:hi][near], self.order[lo:hi][~near]])
            todo += [(lo, lo + middle, node, False), (lo + middle, hi, node, True)]
        self.centre, self.radius = np.array(centres), np.array(radii)
        self.points = points[self.order]


class Best:
    """The k best ``(score, id)`` of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()  # a candidate below the floor is none of the k best
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0, floor.dtype)
        self.id = np.zeros(0, np.int64)
        self.n, self.grown = n, 0

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.query, self.score, self.id = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        self.grown += len(query)
        if self.grown > 2 * self.k * self.n:
            self.cut()

    def cut(self) -> None:
        order = np.lexsort((self.id, -self.score, self.query))
        query = self.query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = order[rank < self.k]
        kth = order[rank == self.k - 1]
        self.floor[self.query[kth]] = np.maximum(self.floor[self.query[kth]], self.score[kth])
        self.query, self.score, self.id, self.grown = self.query[keep], self.score[keep], self.id[keep], 0


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: Best) -> int:
    """Add to ``best`` what a shard has for the queries; returns the number of scores computed."""
    own = ids[tree.order]
    norms = np.sqrt((queries * queries).sum(axis=1))
    scored = 0

    def bound(node: int, active: np.ndarray) -> np.ndarray:
        reach = norms[active] * tree.radius[node]
        exact = queries[active] @ tree.centre[node]
        return exact + reach + 1e-9 * (np.abs(exact) + reach) + 1e-6  # room for rounding

    everyone = np.arange(len(queries))
    first = bound(0, everyone)
    heap = [(-float(first.max(initial=-np.inf)), 0, everyone, first)]
    while heap:
        _, node, active, bounds = heapq.heappop(heap)
        active = active[bounds >= best.floor[active]]
        if not len(active):
            continue
        if tree.left[node] < 0:
            lo, hi = tree.lo[node], tree.hi[node]
            scores = queries[active] @ tree.points[lo:hi].T
            scored += scores.size
            q, c = np.nonzero((scores >= best.floor[active][:, None]) & (own[lo:hi][None, :] != query_ids[active][:, None]))
            best.add(active[q], scores[q, c], own[lo:hi][c])
            continue
        for child in (tree.left[node], tree.right[node]):
            b = bound(child, active)
            open_ = b >= best.floor[active]
            if open_.any():
                heapq.heappush(heap, (-float(b[open_].max()), child, active[open_], b[open_]))
    return scored


def _exact(queries: np.ndarray, points: np.ndarray) -> bool:
    """Whether all inner products, and the sums on the way, are integers that float64 holds."""
    most = np.abs(queries).max(initial=0) * np.abs(points).max(initial=0) * max(1, points.shape[1])
    return bool(most < 2**53)


def _large(ids: np.ndarray, points: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """``(query, score, id)`` of what can be among a shard's ``k`` best, for components too large for float64 to be exact.

    Scores of vectors scaled to 1 choose the candidates, with room for their rounding; Python's integers decide.
    """
    power = lambda m: int(np.frexp(np.abs(m).max(initial=1))[1])
    by_point, by_query = power(points), power(queries)
    small, room, most = np.ldexp(points, -by_point), 1e-12 * max(1, points.shape[1]), float(np.ldexp(1.0, 63 - by_point - by_query))
    whole: dict[int, list[int]] = {}
    for q, query in enumerate(np.ldexp(queries, -by_query)):
        about = np.where(ids == query_ids[q], -np.inf, np.clip(small @ query, -most, most))
        kth = np.partition(about, len(about) - k)[len(about) - k] if len(about) > k else -np.inf
        wide, found = [int(x) for x in queries[q]], []
        for c in np.flatnonzero((about >= kth - 2 * room) & (ids != query_ids[q])).tolist():
            if c not in whole:
                whole[c] = [int(x) for x in points[c]]
            found.append((max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(wide, whole[c], strict=True)))), int(ids[c])))
        for score, i in heapq.nsmallest(k, found, key=lambda x: (-x[0], x[1])):
            yield q, score, i


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = SCALE, query_block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors(vec_id, embedding)`` where ``is_query`` holds."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    queries = vectors.where(is_query)
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    query_block = min(query_block, max(1, BLOCK_BYTES // (8 * max(1, size.d or 1))))
    blocks = max(1, -(-size.n // query_block))
    dealt = written(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "top-k-queries", by=["block"])
    sample = _vectors(vectors.limit(SAMPLE).toArrow(), scale)
    out = fresh_path(spark, "top-k")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for block in range(blocks):  # one block is held at a time
        held = _starts(_vectors(dealt.where(F.col("block") == block).toArrow(), scale), sample, k)
        if not held:
            continue
        first = written(_searched(vectors.where(_early()), held, k, scale, shard), "top-k-early")
        best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id", "copy")
        reached = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("number", "score").toArrow()
        held = _raised(held, reached["number"].to_numpy(), reached["score"].to_numpy())
        found = first.unionByName(_searched(vectors.where(~_early()), held, k, scale, shard))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
        drop_written(first)
    drop_written(dealt)
    return spark.read.schema(schema).parquet(out)


def _early() -> Column:
    """The sixteenth of the vectors that is searched before the others, to raise the kth scores for all tasks."""
    return F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(16)) == 0


def _vectors(table: pa.Table, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """``(ids, matrix)`` of a bounded table, by the length of its vectors."""
    if not len(table):
        return {}
    rows, values = integers(table["embedding"].combine_chunks(), scale)
    ids = table["vec_id"].to_numpy()[rows].astype(np.int64)
    out = {}
    for d in sorted({len(v) for v in values}):
        here = np.array([len(v) == d for v in values])
        out[d] = (ids[here], np.array([v for v in values if len(v) == d]).reshape(int(here.sum()), d))
    return out


def _starts(queries: dict, sample: dict, k: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length ``(ids, matrix, kth scores, numbers)`` of a block's queries, each held against the sample."""
    out, first = {}, 0
    for d, (ids, matrix) in queries.items():
        floor = np.full(len(ids), -np.inf)
        seen_ids, points = sample.get(d, (None, np.zeros((0, d))))
        if len(points) > k and _exact(matrix, points):
            best = Best(len(ids), k, floor)
            search(BallTree(points), seen_ids, matrix, ids, best)
            best.cut()
            floor = best.floor
        out[d] = (ids, matrix, floor, first + np.arange(len(ids)))
        first += len(ids)
    return out


def _raised(held: dict, numbers: np.ndarray, scores: np.ndarray) -> dict:
    """``held`` with the kth scores that the first round reached. Beyond 2**53 a float may lie above the score it stands
    for; then the old one stays."""
    reached = np.full(1 + max((int(n.max(initial=0)) for *_, n in held.values()), default=0), -np.inf)
    small = np.abs(scores) < 2**53
    reached[numbers[small]] = scores[small]
    return {d: (ids, matrix, np.maximum(floor, reached[n]), n) for d, (ids, matrix, floor, n) in held.items()}


def _searched(vectors: DataFrame, held: dict, k: int, scale: int, shard: int) -> DataFrame:
    """``number, query_id, vec_id, score, copy``: what each task found that can be among the best."""
    shared = vectors.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        by, out = shared.value, []
        copy = TaskContext.get().partitionId() << 32
        best = {d: Best(len(q), k, floor) for d, (q, _, floor, _) in by.items()}
        for ids, points in _shards(batches, scale, shard):
            query_ids, matrix, _, numbers = by.get(points.shape[1], (None, None, None, None))
            if query_ids is None:
                continue
            if _exact(matrix, points):
                search(BallTree(points), ids, matrix, query_ids, best[points.shape[1]])
            else:
                out += [(int(numbers[q]), int(query_ids[q]), i, s) for q, s, i in _large(ids, points, matrix, query_ids, k)]
        for d, b in best.items():
            b.cut()
            out += zip(by[d][3][b.query].tolist(), by[d][0][b.query].tolist(), b.id.tolist(), b.score.astype(np.int64).tolist(), strict=True)
        if out:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(copy + np.arange(len(out)))], ["number", "query_id", "vec_id", "score", "copy"])

    return vectors.mapInArrow(run, "number long, query_id long, vec_id long, score long, copy long")


def _shards(batches: Iterator[pa.RecordBatch], scale: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(ids, matrix)`` of up to ``most`` rows of one length."""
    held: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for batch in batches:
        rows, values = integers(batch.column("embedding"), scale)
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)[rows].tolist()
        for i, v in zip(ids, values, strict=True):
            own = held.setdefault(len(v), ([], []))
            own[0].append(i)
            own[1].append(v)
            if len(own[0]) >= most:
                yield np.array(own[0]), np.array(own[1])
                del held[len(v)]
    for ids, values in held.values():
        yield np.array(ids), np.array(values).reshape(len(ids), len(values[0]))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
