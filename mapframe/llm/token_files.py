"""Token-ID files: flat unsigned integers, 64-bit document offsets, partition bases from prefix sums.

A directory of the format holds, for each part in ascending order of its documents:

* ``part-NNNNNN.ids``: token ids of all its documents, one after the other, little-endian ``uint16`` where the
  vocabulary has at most 65,536 ids, ``uint32`` otherwise;
* ``part-NNNNNN.off``: ``n + 1`` little-endian ``uint64``, where each document starts within the part (last: its end);
* ``part-NNNNNN.doc``: ``n`` little-endian ``int64`` document ids, and ``part-NNNNNN.nul``: ``n`` bytes, 1 where the id is null;

and ``manifest.json`` with the number of documents and ids of each part and its base: the ids of all parts before it,
a prefix sum over one small row a part. Readers map ``.ids`` and ``.off`` into memory; nothing is parsed.

Defined results: null text counts as empty and has its end id alone; rows with equal ids each keep their place, ordered
by a hash of their text; a null id sorts first; an empty table gives a manifest without parts; columns other than the
id and the text are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapframe.llm.common import blocks, filesystem, fresh_path
from mapframe.llm.encoding import BLOCK_BYTES, encoder, vocabulary_size

#: Bytes of text of a part, about, at most.
PART_BYTES = 256 << 20
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, tokenizer: str, out_dir: str, end_id: int, parts: int | None = None) -> dict:
    """Encode ``docs(doc_id, text)`` and write the format under ``out_dir``; returns the manifest.

    One range shuffle orders the texts by id, then each task encodes and writes its own part, so no task needs another's
    ids. A task writes to a name of its attempt and renames at its end: a task that runs again leaves one whole file.
    The number of parts, if not given, is the session's number of shuffle partitions, or more: a part has about
    :data:`PART_BYTES` of text at most, whatever the input.
    """
    spark = docs.sparkSession
    if not parts:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    dtype = "<u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, root = filesystem(out_dir)
        fs.create_dir(root, recursive=True)
        stem = f"{root}/part-{part:06d}"
        names = {k: (f"{stem}.{k}.{attempt}.tmp", f"{stem}.{k}") for k in ("ids", "off", "doc", "nul")}
        docs_here = ids_here = 0
        open_files = {k: fs.open_output_stream(x[0]) for k, x in names.items()}
        open_files["off"].write(np.zeros(1, "<u8").tobytes())
        for block in blocks(batches, most=BLOCK_BYTES):
            ids, offsets = encoder(tokenizer).encode(block.column("text"))
            n = block.num_rows
            out = np.full(len(ids) + n, end_id, dtype)
            out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
            doc = block.column("doc_id")
            open_files["ids"].write(out.tobytes())
            open_files["off"].write((ids_here + offsets[1:] + np.arange(1, n + 1)).astype("<u8").tobytes())
            open_files["doc"].write(doc.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            open_files["nul"].write(doc.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
            docs_here, ids_here = docs_here + n, ids_here + len(out)
        for k, stream in open_files.items():
            stream.close()
            if docs_here:
                fs.move(*names[k])
            else:
                fs.delete_file(names[k][0])
        if docs_here:
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [docs_here], "ids": [ids_here]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_t", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(parts, "doc_id", "_t").sortWithinPartitions("doc_id", "_t").drop("_t")
    rows = sorted(ordered.mapInArrow(write, "part long, docs long, ids long").collect())  # one row a part
    bases = np.concatenate([[0], np.cumsum([r.ids for r in rows], dtype=np.int64)]).tolist()
    manifest = {"dtype": dtype, "parts": [{"part": r.part, "docs": r.docs, "ids": r.ids, "base": b} for r, b in zip(rows, bases, strict=False)]}
    fs, root = filesystem(out_dir)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(out_dir: str) -> dict:
    fs, root = filesystem(out_dir)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def open_part(out_dir: str, part: int, dtype: str):
    """``(ids, offsets, doc ids, nulls)`` of a part; local files are mapped, those of a store are read by range."""
    from pyarrow import fs as pafs

    fs, root = filesystem(out_dir)
    stem = f"{root}/part-{part:06d}"
    if isinstance(fs, pafs.LocalFileSystem):
        return tuple(np.memmap(f"{stem}.{k}", dtype=t, mode="r") for k, t in (("ids", dtype), ("off", "<u8"), ("doc", "<i8"), ("nul", "u1")))
    return (_Ranges(fs.open_input_file(f"{stem}.ids"), dtype), *(np.frombuffer(fs.open_input_stream(f"{stem}.{k}").read(), t) for k, t in (("off", "<u8"), ("doc", "<i8"), ("nul", "u1"))))


class _Ranges:
    """Slices of a remote file of integers."""

    def __init__(self, file, dtype: str):
        self.file, self.dtype = file, np.dtype(dtype)

    def __getitem__(self, at: slice) -> np.ndarray:
        size = self.dtype.itemsize
        self.file.seek(at.start * size)
        return np.frombuffer(self.file.read((at.stop - at.start) * size), self.dtype)


def read_token_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row a document, from the files: ``doc_id, start, n_tokens, ids_crc32`` (start counts over all parts)."""
    manifest = read_manifest(out_dir)
    dtype = manifest["dtype"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                ids, offsets, doc, null = open_part(out_dir, part, dtype)
                for k in range(0, len(doc), 5000):
                    at = offsets[k : min(k + 5000, len(doc)) + 1].astype(np.int64)
                    crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(doc[k : k + 5000]), pa.int64(), mask=np.asarray(null[k : k + 5000]).astype(bool)), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(p["part"], p["base"]) for p in manifest["parts"]]
    listed = spark.createDataFrame(rows, "part long, base long").repartitionByRange(max(1, len(rows)), "part")
    return listed.mapInArrow(read, READ_SCHEMA)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out_dir = fresh_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), out_dir, end_id=2)
    return read_token_files(spark, out_dir)
