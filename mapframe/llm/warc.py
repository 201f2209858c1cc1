"""WARC archives of pages: writing, normalising monolithic gzip files, reading by a sidecar index.

A crawl is often stored as one gzip stream over a whole WARC file, which can only be read from its start. The
normaliser inflates such a stream once, record by record, rewrites each record as a gzip member of its own, and writes
``<file>.idx`` beside it: 16 bytes a record, the little-endian ``uint64`` offset and length of its member. A reader then
fetches any record with one ranged read.

Pages with equal payloads (by SHA-1 and length) of at least ``least_bytes`` bytes share one response record, that of
the largest page_id; the others are revisit records that name it.

Defined results: a null html counts as the empty payload, a null url leaves out the target URI, control characters in a
url are percent-encoded; rows that repeat the largest page_id of a payload are all responses; a null page_id is no
candidate for the response unless all are null, when all are responses; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapframe.llm.common import filesystem, fresh_path, written

READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Digests with copies that are broadcast at most (about 60 bytes each), those with the most copies first.
MOST_BROADCAST = 200_000
_URN = "urn:page:"


def planned(pages: DataFrame, least_bytes: int = 0, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``page_id, url, html, record_type, refers_to``. Digests alone are grouped; payloads move only if the table of
    repeated digests is too large to broadcast, and then its most frequent ones, which would skew the join, still are."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.withColumns({"_sha": F.unhex(F.sha1(F.col("html").cast("binary"))), "_n": F.octet_length("html")})
    copies = keyed.where(F.col("_n") >= least_bytes).groupBy("_sha", "_n").agg(F.count("*").alias("_copies"), F.max("page_id").alias("_first")).where("_copies > 1")
    copies = written(copies, "payload-copies")
    cold = None
    if copies.count() <= most_broadcast:
        hot = copies
    else:
        hot = written(copies.orderBy(F.desc("_copies"), "_sha", "_n").limit(most_broadcast), "payload-copies-hot")
        cold = copies.join(F.broadcast(hot.select("_sha", "_n")), ["_sha", "_n"], "left_anti")
    known = keyed.join(F.broadcast(hot.select("_sha", "_n", "_first", F.lit(True).alias("_hot"))), ["_sha", "_n"], "left")
    if cold is not None:
        rest = known.where("_hot is null").drop("_first").join(cold.select("_sha", "_n", "_first"), ["_sha", "_n"], "left")
        known = known.where("_hot").unionByName(rest)
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return known.select("page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. The HTTP headers, with the payload's length, stay in a revisit; the payload does not."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records_of(stream: io.BufferedReader) -> Iterator[bytes]:
    """The records of an inflated WARC stream, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {line[:40]!r}")
        head, length = [line], None
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("the stream ends within the headers of a record")
            head.append(line)
            if line[:15].lower() == b"content-length:":
                length = int(line[15:])
        if length is None:
            raise ValueError("a record has no Content-Length")
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("the stream ends within the block of a record")
        yield b"".join(head) + b"\r\n" + block + b"\r\n\r\n"


def normalise(source: str, target: str, level: int = 3) -> int:
    """Rewrite the gzip WARC ``source`` as ``target`` with a member for each record, and write ``target.idx``.

    One pass with the memory of one record; returns the number of records. Files appear under their names when whole.
    """
    fs, src = filesystem(source)
    out_fs, dst = filesystem(target)
    offset = count = 0
    tmp = f"{dst}.{_attempt()}.tmp"
    with fs.open_input_stream(src, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as stream, out_fs.open_output_stream(tmp, compression=None) as out, out_fs.open_output_stream(f"{tmp}.idx", compression=None) as index:
        for one in records_of(stream):
            packer = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = packer.compress(one) + packer.flush()
            out.write(member)
            index.write(np.array([offset, len(member)], "<u8").tobytes())
            offset, count = offset + len(member), count + 1
    out_fs.move(f"{tmp}.idx", f"{dst}.idx")
    out_fs.move(tmp, dst)
    return count


def _attempt() -> int:
    from pyspark import TaskContext

    return TaskContext.get().taskAttemptId() if TaskContext.get() else 0


def parsed(one: bytes) -> tuple[int | None, int, str, str, int | None]:
    """``READ_SCHEMA`` of a record; length and digest of a response are taken from its payload."""
    head, _, block = one[:-4].partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, own, refers = fields["WARC-Type"], fields["WARC-Record-ID"][len(_URN) + 1 : -1], fields.get("WARC-Refers-To")
    page_id = int(own) if own else None
    if kind == "response":
        return page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, None
    length = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    return page_id, length, fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, int(refers[len(_URN) + 1 : -1])


def write_archives(plan: DataFrame, out_dir: str, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> list[int]:
    """Write one monolithic ``part-NNNNNN.mono.gz`` a task under ``out_dir``; returns the parts that have records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = filesystem(out_dir)
        fs.create_dir(root, recursive=True)
        name, count = f"{root}/part-{part:06d}.mono.gz", 0
        with fs.open_output_stream(tmp := f"{name}.{_attempt()}.tmp", compression=None) as out:
            packer = zlib.compressobj(level, zlib.DEFLATED, 31)
            for batch in batches:
                columns = (batch.column(c) for c in ("page_id", "url", "html", "refers_to"))
                for page_id, url, html, refers_to in zip(*columns, strict=True):
                    out.write(packer.compress(record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), refers_to.as_py(), date)))
                    count += 1
            out.write(packer.flush())
        if count:
            fs.move(tmp, name)
            yield pa.RecordBatch.from_pydict({"part": [part]})
        else:
            fs.delete_file(tmp)

    plan = plan.withColumn("html", F.col("html").cast("binary"))
    return sorted(r.part for r in plan.mapInArrow(write, "part long").collect())  # one row a task


def normalise_archives(spark: SparkSession, out_dir: str, parts: list[int], keep: bool = False) -> None:
    """Normalise each monolithic part, one task each; the monolithic file goes afterwards unless ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                stem = f"{out_dir}/part-{part:06d}"
                fs, path = filesystem(f"{stem}.mono.gz")
                if fs.get_file_info(path).is_file:  # else an earlier attempt of this task has ended its work
                    normalise(f"{stem}.mono.gz", f"{stem}.warc.gz")
                    if not keep:
                        fs.delete_file(path)
                yield pa.RecordBatch.from_pydict({"part": [part]})

    _listed(spark, parts).mapInArrow(run, "part long").collect()


def _listed(spark: SparkSession, parts: list[int]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in parts], "part long").repartitionByRange(max(1, len(parts)), "part")


def read_archives(spark: SparkSession, out_dir: str, parts: list[int]) -> DataFrame:
    """:data:`READ_SCHEMA` of every record, fetched by the offsets of the sidecar indexes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for part in batch.column("part").to_pylist():
                fs, path = filesystem(f"{out_dir}/part-{part:06d}.warc.gz")
                index = np.frombuffer(fs.open_input_stream(f"{path}.idx").read(), "<u8").reshape(-1, 2)
                with fs.open_input_file(path) as file:
                    for k in range(0, len(index), 2000):
                        rows = [parsed(gzip.decompress(file.read_at(int(n), int(at)))) for at, n in index[k : k + 2000]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return _listed(spark, parts).mapInArrow(read, READ_SCHEMA)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_dir = fresh_path(spark, "warc")
    parts = write_archives(planned(spark.read.parquet(f"{sf_dir}/pages.parquet")), out_dir)
    normalise_archives(spark, out_dir, parts)
    return read_archives(spark, out_dir, parts)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n FROM pages
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, n) AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM w
"""
