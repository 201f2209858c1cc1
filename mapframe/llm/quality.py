"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

The score of a text is ``w0 + sum(w_i x_i) + sum over pairs <v_i, v_j> x_i x_j``; the pairs are summed in linear time as
half of ``(sum v_i x_i)**2 - sum (v_i x_i)**2`` for each factor. Features are the text's distinct words, hashed, with a
weight that makes their squares sum to one, and the bins of its statistics. Nothing but the text is looked at.

The model is fitted on a bounded sample of labelled rows (:data:`SAMPLE`, those with the smallest hash of their id), by
stochastic gradients on the driver, and broadcast: its size does not depend on the corpus.

Defined results: null text counts as empty; an empty text gets the score of its statistics; labels that are null or
have no document are not learnt from, labels that repeat weigh each; without any label every score is 0.5; repeated
rows get a row each; a null id counts as the empty text where rows are held out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapframe.llm.common import WHITE, blocks, bytes_of, group_rows, offsets_of, text_of, words
from mapframe.llm.hashing import xxh64

BUCKETS, FACTORS = 1 << 14, 8
#: Labelled rows the model is fitted on at most.
SAMPLE = 12_000
THRESHOLD = 0.3
_BINS = 12


def statistics(texts: pa.Array) -> np.ndarray:
    """Ten numbers a text: logarithms of its length in words and lines, and shares between 0 and 1."""
    data, bounds = bytes_of(texts), offsets_of(texts)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    flat, at = words(texts, WHITE, lower=False)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n, row = np.diff(at), group_rows(at)
    again = np.concatenate([[False], (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])]) if len(codes) else np.zeros(0, bool)
    repeats = np.bincount(row, weights=again, minlength=len(n))
    distinct = np.bincount(np.unique(row * (len(codes) + 1) + codes) // (len(codes) + 1), minlength=len(n)) if len(codes) else np.zeros(len(n))
    size, letters_up, letters_low = np.maximum(np.diff(bounds), 1), count((data >= 65) & (data <= 90)), count((data >= 97) & (data <= 122))
    table = np.zeros(256, bool)
    table[np.frombuffer(b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~", np.uint8)] = True
    lines = count(data == 10) + 1
    w = np.maximum(n, 1)
    return np.stack([
        np.log2(1 + n) / 16, np.log2(lines) / 12, letters_up / np.maximum(letters_up + letters_low, 1), np.minimum(1, 4 * count(table[data]) / size),
        np.minimum(1, 8 * count((data >= 48) & (data <= 57)) / size), count(data >= 128) / size, repeats / w, distinct / w,
        np.minimum(1, np.diff(bounds) / w / 24), np.minimum(1, w / lines / 200),
    ], axis=1)


N_FEATURES = BUCKETS + 10 * _BINS


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(feature numbers, weights, offsets per text)``; each feature of a text once."""
    texts = text_of(texts)
    flat, at = words(texts, WHITE)
    coded = flat.dictionary_encode()
    spelled = coded.dictionary
    bounds = offsets_of(spelled) if len(spelled) else np.zeros(1, np.int64)
    bucket = (xxh64(bytes_of(spelled), bounds[:-1], np.diff(bounds), 7) % np.uint64(BUCKETS)).astype(np.int64)
    own = np.unique(group_rows(at) * BUCKETS + bucket[coded.indices.to_numpy(zero_copy_only=False)]) if len(flat) else np.zeros(0, np.int64)
    many = np.bincount(own // BUCKETS, minlength=len(texts))
    bins = np.minimum((statistics(texts) * _BINS).astype(np.int64), _BINS - 1) + np.arange(10) * _BINS + BUCKETS
    numbers = np.empty(len(own) + bins.size, np.int32)
    weights = np.empty(len(numbers), np.float32)
    offsets = np.concatenate([[0], np.cumsum(many + 10)])
    is_bin = np.zeros(len(numbers), bool)
    is_bin[(offsets[1:, None] - np.arange(10, 0, -1)).ravel()] = True
    numbers[is_bin], weights[is_bin] = bins.ravel(), 1.0
    numbers[~is_bin], weights[~is_bin] = own % BUCKETS, np.repeat(1 / np.sqrt(np.maximum(many, 1)), many)
    return numbers, weights, offsets


class Machine:
    """``w0``, ``w`` and ``v`` of a factorisation machine with a logistic output."""

    def __init__(self, n: int = N_FEATURES, factors: int = FACTORS, seed: int = 11):
        self.w0, self.w = 0.0, np.zeros(n, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (n, factors)).astype(np.float32)

    def raw(self, numbers: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(value of each row, factor sums of each row, v_i x_i)``; every row has a feature."""
        if len(offsets) == 1:
            return np.zeros(0), np.zeros((0, self.v.shape[1])), np.zeros((0, self.v.shape[1]))
        vx = self.v[numbers] * weights[:, None]
        sums = np.add.reduceat(vx, offsets[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), offsets[:-1])
        linear = np.add.reduceat(self.w[numbers] * weights, offsets[:-1])
        return self.w0 + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums, vx

    def score(self, numbers: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(numbers, weights, offsets)[0].astype(np.float64), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1, decay: float = 1e-5) -> Machine:
        """AdaGrad on the logistic loss, in a fixed random order."""
        if not len(rows):
            return self
        share = (labels.sum() + 1) / (len(labels) + 2)
        self.w0 = float(np.log(share / (1 - share)))
        rng = np.random.default_rng(5)
        gw, gv = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                numbers, weights = (np.concatenate([rows[i][j] for i in own]) for j in (0, 1))
                offsets = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in own])])
                raw, sums, vx = self.raw(numbers, weights, offsets)
                miss = (1 / (1 + np.exp(-raw)) - labels[own]) / len(own)
                self.w0 -= rate * float(miss.sum())
                each = np.repeat(miss, np.diff(offsets))
                at, place = np.unique(numbers, return_inverse=True)
                w_step = np.bincount(place, weights=each * weights, minlength=len(at)) + decay * self.w[at]
                v_each = (each * weights)[:, None] * (np.repeat(sums, np.diff(offsets), axis=0) - vx)
                v_step = np.stack([np.bincount(place, weights=v_each[:, f], minlength=len(at)) for f in range(self.v.shape[1])], axis=1) + decay * self.v[at]
                gw[at] += w_step**2
                gv[at] += v_step**2
                self.w[at] -= (rate * w_step / np.sqrt(gw[at])).astype(np.float32)
                self.v[at] -= (rate * v_step / np.sqrt(gv[at])).astype(np.float32)
        return self


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on the ``labels(doc_id, quality)`` that are not held out, ``sample`` rows at most."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            numbers, weights, offsets = features(block.column("text"))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (numbers, weights)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("quality"), *lists], ["doc_id", "quality", "numbers", "weights"])

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, quality int, numbers array<int>, weights array<float>").toArrow()
    order = np.lexsort((found["quality"].to_numpy(), found["doc_id"].to_numpy()))
    numbers, weights = ([x.values.to_numpy() for x in found[c]] for c in ("numbers", "weights"))
    return Machine().fit([(numbers[i], weights[i]) for i in order], found["quality"].to_numpy()[order].astype(np.float64))


def scored(docs: DataFrame, machine: Machine, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if not given) of ``docs`` with ``score``, the probability of label 1.

    Only what is kept comes back from Python, so a caller that needs no text asks for none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            score = pa.array(shared.value.score(*features(block.column("text"))), pa.float64())
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), score], [*keep, "score"])

    read = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in read.select(*keep).dtypes), "score double"])
    return read.mapInArrow(run, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rated = scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), ["doc_id"])
    return rated.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
