"""Queries of the training-data operators and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm import chat, decontam, exact_dedup, html_extract, jaccard_join, langid, sentencepiece_fst, sharding, suffix_dedup, url_filter
from bitloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": lambda s, d: suffix_dedup.op1(table(s, d, "documents")),
    "op2_html_extraction": lambda s, d: html_extract.op2(table(s, d, "pages")),
    "op3_chat_formatting": lambda s, d: chat.op3(s, table(s, d, "conversations")),
    "op4_url_filters": lambda s, d: url_filter.op4(table(s, d, "pages"), table(s, d, "labels")),
    "op5_sharding": lambda s, d: sharding.op5(table(s, d, "documents")),
    "op6_ngram_jaccard_join": lambda s, d: jaccard_join.op6(table(s, d, "documents")),
    "op7_sentencepiece": lambda s, d: sentencepiece_fst.op7(table(s, d, "documents")),
    "op8_decontamination": lambda s, d: decontam.op8(table(s, d, "documents"), table(s, d, "benchmark")),
    "op9_language_id": lambda s, d: langid.op9(table(s, d, "documents")),
    "op10_exact_dedup": lambda s, d: exact_dedup.op10(table(s, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.ORACLE,
    "op3_chat_formatting": chat.ORACLE,
    "op4_url_filters": url_filter.ORACLE,
    "op5_sharding": sharding.ORACLE,
    "op6_ngram_jaccard_join": jaccard_join.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
