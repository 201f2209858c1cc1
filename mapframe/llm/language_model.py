"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax, beside a unigram base.

``P(w | h) = P(class(w) | h) * P(w | class(w), h)``. Both factors are softmaxes over hashed features of the history h:

* a word's class is that of its ending; the features are the ending of the word before, that of the word before it (a
  skip) and both together, which say something about words that were never seen, and a bias;
* within a class each of its most frequent words has a place of its own, and all others share one; the features are the
  word before and, as a skip, the word before it, each with the class. Among the words of the shared place those counts
  decide that are gathered exactly, with one for a word never seen.

So the probabilities of all known words, and of one unknown word in each class, sum to one after any history. The
weights of both start at the counts of the corpus and are trained by distributed gradient updates in one pass: every task
runs stochastic gradients over its share of the training documents, and the changes, weighted by how often each feature
was seen, are added up by a tree of merges and averaged.

Counts of words follow the corpus and are never held in one place; a word is known by 128 bits of hash, so its length
does not matter. Words whose counts are large, a set of bounded size, are broadcast to the scoring pass; the others, each
of which is rare, are joined.

Defined results: null text counts as empty and consists of its end; null ids count as the empty text where documents
are held out; repeated rows get a row each; without training documents every count is 0; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapframe.llm.common import WHITE, blocks, bytes_of, drop_written, offsets_of, ranges, text_of, words, written
from mapframe.llm.hashing import xxh64

CLASSES = 32
#: Places of a class: its most frequent words, and a last one for all others.
SLOTS = 32
#: Rows of the weights: the hashed features of the class of each kind, its bias, the hashed features of the word.
PLACES, WORD_PLACES = (4096, 4096, 8192), (16384, 16384)
BIAS = sum(PLACES)
ROWS = BIAS + 1 + sum(WORD_PLACES)
#: Words that are broadcast at most, 24 bytes each.
HOT = 1 << 19
#: Sightings that a feature is held to have had without a lesson, so that rare ones move little.
PRIOR = 10
#: The first level of the tree that adds up changes: groups of tasks, each by slices of the weights.
_GROUPS, _SLICES = 16, 8
_BATCH = 8192
#: Rows of a run that are added for all runs at once.
_SHORT = 6
_END = bytes(16)


class Tokens:
    """The tokens of a block of texts: codes of its distinct words, each text followed by its end (the last code)."""

    def __init__(self, texts: pa.Array):
        flat, at = words(text_of(texts), WHITE)
        coded = flat.dictionary_encode()
        spelled: pa.Array = coded.dictionary  # without the end
        self.end = len(spelled)
        n = len(at) - 1
        self.offsets = at + np.arange(n + 1)
        self.codes = np.full(len(flat) + n, self.end, np.int64)
        self.codes[ranges(self.offsets[:-1], np.diff(at))] = coded.indices.to_numpy(zero_copy_only=False)
        bounds = offsets_of(spelled) if self.end else np.zeros(1, np.int64)
        data, size = bytes_of(spelled), np.diff(bounds)
        tail = np.minimum(size, 3)  # a word's class is that of its ending; the end has its own
        self.endings = np.append(xxh64(data, bounds[1:] - tail, tail, 1), np.uint64(0))
        self.classes = np.append(1 + (xxh64(data, bounds[1:] - tail, tail, 2) % np.uint64(CLASSES - 1)).astype(np.int64), 0)
        hashes = np.stack([xxh64(data, bounds[:-1], size, seed) for seed in (11, 12)], axis=1)
        self.hashes = np.append(hashes[:, 0], np.uint64(0))
        self.keys = pa.BinaryArray.from_buffers(pa.binary(), self.end + 1, [None, pa.py_buffer((np.arange(self.end + 2) * 16).astype(np.int32)), pa.py_buffer(hashes.tobytes() + _END)])

    def _before(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``own`` of the word before each token and of the word before that."""
        own = own[self.codes]
        one, two = np.roll(own, 1), np.roll(own, 2)
        first = self.offsets[:-1]
        one[first] = two[first] = np.uint64(3)
        second = first[np.diff(self.offsets) > 1] + 1
        two[second] = np.uint64(3)
        return one, two

    def history(self) -> tuple[np.ndarray, ...]:
        """The rows of the weights that belong to the history of each token, for its class."""
        one, two = self._before(self.endings)
        with np.errstate(over="ignore"):
            both = (one * np.uint64(0x9E3779B97F4A7C15)) ^ (two * np.uint64(0xC2B2AE3D27D4EB4F))
            both ^= both >> np.uint64(29)
        return _rows((one, two, both), PLACES, 0)

    def word_history(self) -> tuple[np.ndarray, ...]:
        """The same for its word, once its class is known."""
        own = (self.classes[self.codes] + 77).astype(np.uint64)
        out = []
        for x in self._before(self.hashes):
            with np.errstate(over="ignore"):
                x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (own * np.uint64(0xC2B2AE3D27D4EB4F))
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
                out.append(x ^ (x >> np.uint64(32)))
        return _rows(tuple(out), WORD_PLACES, BIAS + 1)


def _rows(hashes: tuple[np.ndarray, ...], places: tuple[int, ...], first: int) -> tuple[np.ndarray, ...]:
    starts = [first + sum(places[:k]) for k in range(len(places))]
    return tuple((np.uint64(a) + x % np.uint64(n)).astype(np.uint16) for x, n, a in zip(hashes, places, starts, strict=True))


def logits(weights: np.ndarray, rows: tuple[np.ndarray, ...], bias: np.ndarray) -> np.ndarray:
    out = bias + weights[rows[0]]
    for r in rows[1:]:
        out += weights[r]
    return out


def _exps(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(largest, sums)`` of each row, as columns; in place of the logits come their exponentials, the largest being 1. A
    row of :data:`CLASSES` or :data:`SLOTS` is short, so its maximum is taken by halves of all rows and its sum as a product."""
    largest = logits
    while largest.shape[1] > 1:
        half = largest.shape[1] // 2
        largest = np.maximum(largest[:, :half], largest[:, half:])
    logits -= largest
    np.exp(logits, out=logits)
    return largest, logits @ np.ones((logits.shape[1], 1), logits.dtype)


def log_chosen(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax of each row at its ``chosen`` place; the logits are overwritten."""
    own = logits[np.arange(len(chosen)), chosen]
    largest, sums = _exps(logits)
    return own - largest[:, 0] - np.log(sums[:, 0])


class Vocabulary:
    """What the counts of the corpus say: the mass of each class, and the words that have places of their own."""

    def __init__(self, tokens_of: np.ndarray, types_of: np.ndarray, keys: list[bytes], classes: np.ndarray, slots: np.ndarray, counts: np.ndarray):
        self.keys, self.slots = pa.array(keys, pa.binary()), np.append(slots, SLOTS - 1)
        mass = tokens_of + types_of + 1.0  # a word has its count and one; one is for a word never seen
        mass[0] -= types_of[0] > 0  # the end is alone in its class
        self.rest = mass.copy()
        self.bias = np.full((CLASSES, SLOTS), -50.0)
        for c, slot, n in zip(classes.tolist(), slots.tolist(), counts.tolist(), strict=True):
            self.bias[c, slot] = math.log((n + 1) / mass[c])
            self.rest[c] -= n + 1
        self.bias[:, SLOTS - 1] = np.where(self.rest > 0, np.log(np.maximum(self.rest, 1) / mass), -50.0)
        self.bias, self.rest = self.bias.astype(np.float32), np.maximum(self.rest, 1)
        self.start = np.log(mass / mass.sum()).astype(np.float32)

    def slots_of(self, tokens: Tokens) -> np.ndarray:
        """The place of each distinct word, the end included, in its class."""
        found = pc.index_in(tokens.keys, self.keys)
        return self.slots[pc.fill_null(found, len(self.keys)).to_numpy(zero_copy_only=False)]


def _gradient(weights: np.ndarray, rows: tuple[np.ndarray, ...], bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    miss = logits(weights, rows, bias)
    miss /= _exps(miss)[1]
    miss[np.arange(len(target)), target] -= 1
    return miss


def _sums(values: np.ndarray, order: np.ndarray, starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The sum of ``values[order]`` over each run of ``many`` rows. Most runs are short, so the first rows of all are added
    at once; what is left of the others goes to ``reduceat``, whose cost is by run and column."""
    out = values[order[starts]]
    for k in range(1, _SHORT):
        more = np.flatnonzero(many > k)
        out[more] += values[order[starts[more] + k]]
    more = np.flatnonzero(many > _SHORT)
    if len(more):
        rest = many[more] - _SHORT
        out[more] += np.add.reduceat(values[order[ranges(starts[more] + _SHORT, rest)]], np.cumsum(rest) - rest, axis=0)
    return out


def _step(weights: np.ndarray, seen: np.ndarray, squares: np.ndarray, rows: tuple[np.ndarray, ...], miss: np.ndarray, rate: float) -> None:
    """One AdaGrad step for each row of the weights that a batch has."""
    for h in rows:
        order = np.argsort(h, kind="stable")
        ordered = h[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        at, many = ordered[starts], np.diff(np.append(starts, len(ordered)))
        step = _sums(miss, order, starts, many)
        step /= (many + PRIOR).astype(np.float32)[:, None]
        squares[at] += np.einsum("ij,ij->i", step, step) / step.shape[1]
        step *= (rate / np.sqrt(squares[at])).astype(np.float32)[:, None]
        weights[at] -= step
        seen[at] += many


def descend(weights: np.ndarray, seen: np.ndarray, squares: np.ndarray, tokens: Tokens, known: Vocabulary, rate: float) -> None:
    """Gradient steps (one for each :data:`_BATCH` tokens) of both factors over a block, in place."""
    history, by_word = tokens.history(), tokens.word_history()
    target, slot = tokens.classes[tokens.codes], known.slots_of(tokens)[tokens.codes]
    for k in range(0, len(target), _BATCH):
        rows, own = tuple(h[k : k + _BATCH] for h in history), target[k : k + _BATCH]
        miss = _gradient(weights, rows, weights[BIAS], own)
        bias = miss.mean(axis=0)
        squares[BIAS] += float((bias * bias).mean())
        weights[BIAS] -= rate * bias / np.sqrt(squares[BIAS])
        seen[BIAS] += len(own)
        _step(weights, seen, squares, rows, miss, rate)
        rows = tuple(h[k : k + _BATCH] for h in by_word)
        _step(weights, seen, squares, rows, _gradient(weights, rows, known.bias[own], slot[k : k + _BATCH]), rate)


def factors(weights: np.ndarray, tokens: Tokens, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """``(log10 of the probability of each token's class and place, whether that place is the shared one)``; a token of a
    shared place has its count and one, of :attr:`Vocabulary.rest` of its class, of that probability."""
    history, by_word = tokens.history(), tokens.word_history()
    target, slot = tokens.classes[tokens.codes], known.slots_of(tokens)[tokens.codes]
    out = np.empty(len(target))
    for k in range(0, len(target), _BATCH):
        own, place = target[k : k + _BATCH], slot[k : k + _BATCH]
        by_class = log_chosen(logits(weights, tuple(h[k : k + _BATCH] for h in history), weights[BIAS]), own)
        out[k : k + _BATCH] = by_class + log_chosen(logits(weights, tuple(h[k : k + _BATCH] for h in by_word), known.bias[own]), place)
    return out / math.log(10), slot == SLOTS - 1


def word_counts(train: DataFrame) -> DataFrame:
    """``word, cls, n`` over all texts; a word is its key. A task sends each distinct word of a block once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            tokens = Tokens(block.column("text"))
            yield pa.RecordBatch.from_arrays([tokens.keys, pa.array(tokens.classes), pa.array(np.bincount(tokens.codes, minlength=tokens.end + 1))], ["word", "cls", "n"])

    return train.select("text").mapInArrow(run, "word binary, cls long, n long").groupBy("word").agg(F.min("cls").alias("cls"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int, int]:
    """The :class:`Vocabulary`, and how many tokens and words there are; the driver gets a row a class and a row a place."""
    tokens_of, types_of = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():
        tokens_of[r.cls], types_of[r.cls] = r.n, r.types
    place = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("n"), "word")) - 1
    rows = counts.withColumn("slot", place).where(F.col("slot") < SLOTS - 1).collect()
    columns = [np.array([r[c] for r in rows], np.int64) for c in ("cls", "slot", "n")]
    return Vocabulary(tokens_of, types_of, [bytes(r.word) for r in rows], *columns), int(tokens_of.sum()), int(types_of.sum())


def trained(train: DataFrame, known: Vocabulary, rate: float = 0.25) -> np.ndarray:
    """The weights after one pass over ``train(text)``."""
    spark = train.sparkSession
    weights = np.zeros((ROWS, CLASSES), np.float32)
    weights[BIAS] = known.start
    shared = spark.sparkContext.broadcast((weights, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        begun, vocabulary = shared.value
        own, seen, squares = begun.copy(), np.zeros(ROWS), np.full(ROWS, 0.05)
        for block in blocks(batches, most=2 << 20):
            descend(own, seen, squares, Tokens(block.column("text")), vocabulary, rate)
        if seen[BIAS]:
            change = np.concatenate([(own - begun) * seen[:, None], seen[:, None]], axis=1).astype(np.float32)
            pieces = [s.tobytes() for s in np.array_split(change, _SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % _GROUPS] * _SLICES), pa.array(np.arange(_SLICES)), pa.array(pieces, pa.binary())], ["group", "slice", "change"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for group, number, change in zip(batch.column("group").to_pylist(), batch.column("slice").to_pylist(), batch.column("change"), strict=True):
                own = np.frombuffer(change.as_buffer(), np.float32).astype(np.float64)
                sums[group, number] = own if (group, number) not in sums else sums[group, number] + own
        for (group, number), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([number]), pa.array([x.astype(np.float32).tobytes()], pa.binary())], ["group", "slice", "change"])

    schema = "group long, slice long, change binary"
    sums = train.select("text").mapInArrow(run, schema).repartition(_GROUPS * _SLICES // 2, "group", "slice").mapInArrow(total, schema)
    rows = sums.withColumn("group", F.lit(0).cast("long")).repartition(_SLICES, "slice").mapInArrow(total, schema).collect()  # a row a slice
    shared.destroy()
    if rows:
        change = np.concatenate([np.frombuffer(r.change, np.float32) for r in sorted(rows, key=lambda r: r.slice)]).reshape(ROWS, CLASSES + 1)
        weights = (weights + change[:, :-1] / np.maximum(change[:, -1:], 1)).astype(np.float32)
    return weights


def hot_words(counts: DataFrame, most: int = HOT) -> tuple[pa.Array, np.ndarray, DataFrame]:
    """``(frequent words, their counts, the counts of all others)``: a threshold that at most ``most`` words reach, found
    from a histogram of the counts in steps of a sixteenth of a doubling (under 1,100 rows)."""
    step = F.floor(F.log2("n") * 16).cast("int")
    total, threshold = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        total += r.words
        if total > most:
            break
        threshold = r.step
    if threshold is None:
        return pa.array([], pa.binary()), np.zeros(0, np.int64), counts
    table = counts.where(step >= threshold).select("word", "n").toArrow()
    return table["word"].combine_chunks().cast(pa.binary()), table["n"].to_numpy(), counts.where(step < threshold)


def score_documents(docs: DataFrame, held_out, hot: int = HOT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs(doc_id, text)``.

    ``held_out`` is the condition of rows that nothing is learnt from.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    train = docs.where(~F.col("held_out"))
    counts = written(word_counts(train), "word-counts")
    vocabulary_, n_train, v_train = vocabulary(counts)
    model = spark.sparkContext.broadcast((trained(train, vocabulary_), vocabulary_))
    frequent, frequent_n, rare = hot_words(counts, hot)
    known = spark.sparkContext.broadcast((frequent, np.append(frequent_n, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, n), (weights, own) = known.value, model.value
        room = np.log10(own.rest)
        for block in blocks(batches, most=4 << 20):
            tokens = Tokens(block.column("text"))
            at = pc.index_in(tokens.keys, keys)
            count = n[pc.fill_null(at, len(keys)).to_numpy(zero_copy_only=False)]
            log_count, missing = np.log10(count + 1)[tokens.codes], at.is_null().to_numpy(zero_copy_only=False)
            model_, plain = factors(weights, tokens, own)
            model_ += plain * (log_count - room[tokens.classes[tokens.codes]])
            first = tokens.offsets[:-1]
            sums = [np.add.reduceat(x, first) for x in (log_count, model_, (count > 0)[tokens.codes].astype(np.int64))]
            # The words that are not among the frequent ones, once a text.
            rest = np.flatnonzero(missing[tokens.codes])
            row = np.searchsorted(tokens.offsets, rest, "right") - 1
            pairs, place, many = np.unique(row * (tokens.end + 1) + tokens.codes[rest], return_index=True, return_counts=True)
            lists = np.concatenate([[0], np.cumsum(np.bincount(pairs // (tokens.end + 1), minlength=len(first)))])
            entries = pa.StructArray.from_arrays([tokens.keys.take(pa.array(pairs % (tokens.end + 1))), pa.array(many, pa.int64()), pa.array(plain[rest[place]])], ["word", "times", "plain"])
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("held_out"), pa.array(np.diff(tokens.offsets)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), entries)],
                ["doc_id", "held_out", "n_tokens", "log_counts", "model", "n_known", "rest"],
            )

    scored = docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, log_counts double, model double, n_known long, rest array<struct<word:binary,times:long,plain:boolean>>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "language-model-rows")
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.*").join(rare.select("word", "n"), "word")
    log_n = F.col("times") * F.log10(F.col("n") + 1)
    rest = rest.groupBy("row").agg(F.sum(log_n).alias("more_log"), F.sum(F.when(F.col("plain"), log_n).otherwise(0.0)).alias("more_model"), F.sum("times").alias("more_known"))
    rest = written(rest, "language-model-rest")
    drop_written(counts)
    out = scored.drop("rest").join(rest, "row", "left")
    zero, base_room = F.lit(0.0), math.log10(n_train + v_train + 1)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("log_counts") + F.coalesce("more_log", zero) - F.col("n_tokens") * F.lit(base_room)).alias("base_score"), (F.col("model") + F.coalesce("more_model", zero)).alias("score"),
    )


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mapframe.llm.quality import remainder

    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), remainder("doc_id", 7) == 2)
