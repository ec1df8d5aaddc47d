"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dictspark.llm.chat import OP7_SQL, op7_chat_formatting
from dictspark.llm.decontaminate import op2_benchmark_decontamination
from dictspark.llm.jpeg import op8_media_columns
from dictspark.llm.langid import op4_language_id
from dictspark.llm.licenses import OP3_SQL, op3_license_scan
from dictspark.llm.linededup import OP9_SQL, op9_line_dedup
from dictspark.llm.minhash import op10_minhash_near_dedup
from dictspark.llm.mixing import op5_source_mixing
from dictspark.llm.quality import op6_quality_classifier
from dictspark.llm.tokenbin import op1_token_id_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_id_output": op1_token_id_output,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_source_mixing": op5_source_mixing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_media_columns": op8_media_columns,
    "op9_line_dedup": op9_line_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}
ORACLES: dict[str, str] = {
    "op3_license_scan": OP3_SQL,
    "op7_chat_formatting": OP7_SQL,
    "op9_line_dedup": OP9_SQL,
}
