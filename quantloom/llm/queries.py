"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import exact_dedup, language_id, lexical_search, license_scan, minhash, packing, prefix_trie, quality, repeated_spans, secret_scan, segmentation, toxicity, transport_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_transport_streams": transport_stream.op5_transport_streams,
    "op6_segmentations": segmentation.op6_segmentations,
    "op7_quality": quality.op7_quality,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_repeated_spans": repeated_spans.op9_repeated_spans,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_conversation_trie": prefix_trie.op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": license_scan.OP3_SQL,
    "op4_secret_scan": secret_scan.OP4_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_conversation_trie": prefix_trie.OP13_SQL,
}
