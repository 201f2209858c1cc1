"""Hierarchical multi-length packing of token sequences.

Documents are routed to context-size tiers, each tier is packed into windows of its size, gaps of long windows are
filled from shorter tiers, and full windows are dealt to step groups of an equal number of tokens.

A task packs the documents it reads, a block at a time, so there is no shuffle, memory is bounded by the block, and a
task that runs again packs the same documents the same way. What a block leaves over joins the next block; what the
last block of a task leaves over is cut into windows whose sizes are powers of two. Every window is therefore full, and
nothing is padded; a piece is cut only to close a window.

Defined results: null text counts as empty and has its end id alone; repeated rows and rows with equal or null ids are
packed each for itself; an empty table gives no piece; columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapframe.llm.common import blocks
from mapframe.llm.encoding import BLOCK_BYTES, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"
TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group: as many windows of one tier as hold so many tokens.
STEP_TOKENS = 32 * 2048


class Packer:
    """Packs pieces ``(document, start, length)``, given lengths only; keeps what does not fill a window yet."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers are powers of two")
        self.most = self.tiers[-1]
        self.waiting: list[list[tuple[int, int, int]]] = [[] for _ in range(self.most + 1)]  # by length
        self.lengths = 0  # bit n is set where pieces of length n wait

    def _put(self, piece: tuple[int, int, int]) -> None:
        self.waiting[piece[2]].append(piece)
        self.lengths |= 1 << piece[2]

    def _take(self, length: int) -> tuple[int, int, int]:
        stack = self.waiting[length]
        piece = stack.pop()
        if not stack:
            self.lengths &= ~(1 << length)
        return piece

    def add(self, document: int, length: int) -> Iterator[list[tuple[int, int, int]]]:
        """Route a document: windows of the longest tier are cut off at once, the rest waits in the tier that holds it."""
        start = 0
        while length - start >= self.most:
            yield [(document, start, self.most)]
            start += self.most
        if length > start:
            self._put((document, start, length - start))

    def pack(self) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows, from the longest tier to the shortest; each starts with the longest piece that waits."""
        for tier, below in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0], strict=True):
            while (self.lengths >> (below + 1)) & ((1 << (tier - below)) - 1):
                longest = (self.lengths & ((1 << (tier + 1)) - 1)).bit_length() - 1
                window, gap = [self._take(longest)], tier - longest
                while gap:
                    if fits := self.lengths & ((1 << (gap + 1)) - 1):
                        window.append(self._take(fits.bit_length() - 1))
                        gap -= window[-1][2]
                    elif over := self.lengths >> (gap + 1):  # none fits: cut the shortest that waits
                        document, start, length = self._take(gap + 1 + (over & -over).bit_length() - 1)
                        window.append((document, start, gap))
                        self._put((document, start + gap, length - gap))
                        gap = 0
                    else:
                        break
                if gap:  # nothing waits any more: this window waits for the next block
                    for piece in window:
                        self._put(piece)
                    return
                yield window

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """What still waits, cut into full windows of powers of two."""
        left = [p for stack in self.waiting for p in stack][::-1]
        self.waiting, self.lengths = [[] for _ in self.waiting], 0
        total = sum(p[2] for p in left)
        while total:
            size = min(self.most, 1 << (total.bit_length() - 1))
            window, gap = [], size
            while gap:
                document, start, length = left.pop()
                window.append((document, start, min(gap, length)))
                if length > gap:
                    left.append((document, start + gap, length - gap))
                gap -= window[-1][2]
            total -= size
            yield window


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, block_bytes: int = BLOCK_BYTES, chunks: int | None = None) -> DataFrame:
    """One row a piece: where it comes from (``doc_id``, ``start``, ``length``) and goes (``sequence_id``, ``offset``).

    ``window`` is the size of the sequence; ``step_group`` numbers groups of windows of one size with ``step_tokens``
    tokens together. ``sequence_id`` and ``step_group`` start with the task's partition, so they are unique. A worker's memory
    follows the ``block_bytes`` of text that it encodes together and the distinct ``chunks`` of text that it remembers.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 36
        packer, sequences, groups = Packer(tiers), 0, 0
        dealt: dict[int, tuple[int, int]] = {}  # window size: (step group, tokens it still takes)
        held: dict[int, tuple[int | None, np.ndarray, int]] = {}  # documents with tokens that wait
        number = 0

        def rows(windows: Iterator[list[tuple[int, int, int]]]) -> Iterator[tuple]:
            nonlocal sequences, groups
            for window in windows:
                size = sum(p[2] for p in window)
                group, room = dealt.get(size, (0, 0))
                if room < size:
                    group, room, groups = groups, max(step_tokens, size), groups + 1
                dealt[size] = (group, room - size)
                offset = 0
                for document, start, length in window:
                    doc_id, ids, left = held[document]
                    yield doc_id, start, length, zlib.crc32(ids[start : start + length]), len(ids), part + sequences, offset, size, part + group
                    offset += length
                    if left == length:
                        del held[document]
                    else:
                        held[document] = (doc_id, ids, left - length)
                sequences += 1

        def batch(found: list[tuple]) -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

        for block in blocks(batches, most=block_bytes):
            ids, offsets = encoder(tokenizer, chunks).encode(block.column("text"))
            found: list[tuple] = []
            for doc_id, a, b in zip(block.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                held[number] = (doc_id, own, len(own))
                found += rows(packer.add(number, len(own)))
                number += 1
            found += rows(packer.pack())
            if found:
                yield batch(found)
        if found := list(rows(packer.rest())):
            yield batch(found)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
