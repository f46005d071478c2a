"""The registered queries of the corpus operators and, where SQL can state them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe_codec, chat_format, collocations, main_text, packing, quality_model, quality_rules, secret_scan, simhash, source_audit, token_counts, token_store, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_quality_classifier": quality_model.op2_quality_classifier,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_token_store": token_store.op5_token_store,
        "op6_bpe_codec": bpe_codec.op6_bpe_codec,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_chat_format": chat_format.op8_chat_format,
        "op9_exact_top_k": topk.op9_exact_top_k,
        "op10_simhash_groups": simhash.op10_simhash_groups,
        "op11_source_audit": source_audit.op11_source_audit,
        "op12_main_text": main_text.op12_main_text,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secret_scan.OP1_SQL,
        "op8_chat_format": chat_format.OP8_SQL,
        "op9_exact_top_k": topk.OP9_SQL,
        "op11_source_audit": source_audit.OP11_SQL,
        "op13_collocations": collocations.OP13_SQL,
    }
