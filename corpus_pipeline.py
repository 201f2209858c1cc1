"""A training corpus from raw documents, in five stages; each calls one operator of :mod:`mapframe.llm`.

A stage takes the whole table that its predecessor kept, written as Parquet in the shared folder, and returns the columns
of ``documents``; the last returns the pieces of packed sequences. Rows with nulls, repeated rows and empty tables pass
as the operators define it; columns beyond those of ``documents`` are left behind by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapframe.llm import decontamination, line_dedup, near_copies, packing, quality
from mapframe.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of these documents."""
    docs = docs.select(*COLUMNS)
    machine = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, machine).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; those of which no word remains go."""
    done = line_dedup.dedup_lines(docs.select(*COLUMNS))
    changed = F.size("dropped") > 0
    done = done.where(~changed | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return done.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard similarity of 0.8 or more), that of the
    smallest id."""
    return near_copies.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontamination.without_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of all documents, in full windows. Small blocks, since the workers run beside the heap that the stages
    before have grown."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, block_bytes=1 << 20, chunks=150_000)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL can't express the first and the last stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
