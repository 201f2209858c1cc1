"""The queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mapframe.llm import decontamination, language_model, line_dedup, pii, quality, simhash, top_k, warc
from mapframe.llm.packing import op2_packing
from mapframe.llm.token_files import op8_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_packing": op2_packing,
    "op3_top_k": top_k.op3_top_k,
    "op4_language_model": language_model.op4_language_model,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_warc": warc.op6_warc,
    "op7_quality": quality.op7_quality,
    "op8_token_files": op8_token_files,
    "op9_simhash": simhash.op9_simhash,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op3_top_k": top_k.ORACLE_SQL,
    "op5_decontamination": decontamination.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
}
