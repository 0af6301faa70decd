"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialspark.llm.conversations import OP13_SQL, op13_conversation_repair
from trialspark.llm.decontaminate import op8_benchmark_leaks
from trialspark.llm.fingerprint import op7_fingerprints
from trialspark.llm.jaccard import OP6_SQL, op6_similar_documents
from trialspark.llm.language import op10_languages
from trialspark.llm.licenses import op2_licenses
from trialspark.llm.mixing import OP1_SQL, op1_mix_sources
from trialspark.llm.runs import op11_periodic_runs
from trialspark.llm.sharding import OP12_SQL, op12_hilbert_shards
from trialspark.llm.substring import OP5_SQL, op5_repeated_windows
from trialspark.llm.tokens import op9_token_counts
from trialspark.llm.toxicity import op4_toxicity
from trialspark.llm.warc import OP3_SQL, op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_licenses": op2_licenses,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_repeated_windows": op5_repeated_windows,
    "op6_similar_documents": op6_similar_documents,
    "op7_fingerprints": op7_fingerprints,
    "op10_languages": op10_languages,
    "op8_benchmark_leaks": op8_benchmark_leaks,
    "op9_token_counts": op9_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hilbert_shards": op12_hilbert_shards,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": OP1_SQL,
    "op3_warc": OP3_SQL,
    "op5_repeated_windows": OP5_SQL,
    "op6_similar_documents": OP6_SQL,
    "op12_hilbert_shards": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}
