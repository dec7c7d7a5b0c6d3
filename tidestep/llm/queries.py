"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidestep.llm import bpe, decontaminate, langid, licenses, line_dedup, quality, simhash, substring_dedup, suffix_dedup, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": licenses.op1_licenses,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_passages": substring_dedup.op3_passages,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op3_all_lines": substring_dedup.op3_all_lines,
    "op4_topk": topk.op4_topk,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_quality": quality.op6_quality,
    "op7_langid": langid.op7_langid,
    "op8_bpe": bpe.op8_bpe,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL: dict[str, str] = {
    "op1_licenses": licenses.OP1_SQL,
    "op3_passages": substring_dedup.OP3_PASSAGES_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op3_all_lines": substring_dedup.OP3_ALL_SQL,
    "op4_topk": topk.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
}
