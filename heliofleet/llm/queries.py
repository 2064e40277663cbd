"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact_dedup, language, line_dedup, lm_score, ngram_join, packing, prefix_trie, secrets, substring, topk, vector_codes


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries():
    return {
        "op1_exact_top_k": topk.op1_exact_top_k,
        "op2_secret_scans": secrets.op2_secret_scans,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_language_id": language.op4_language_id,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_ngram_jaccard_join": ngram_join.op7_ngram_jaccard_join,
        "op8_chat_formatting": chat.op8_chat_formatting,
        "op9_bpe_round_trip": bpe.op9_bpe_round_trip,
        "op10_substring_dedup": substring.op10_substring_dedup,
        "op11_vector_code_compression": vector_codes.op11_vector_code_compression,
        "op12_lm_scoring": lm_score.op12_lm_scoring,
        "op13_conversation_prefix_trie": prefix_trie.op13_conversation_prefix_trie,
        "pipeline": pipeline,
    }


def oracles():
    return {
        "op1_exact_top_k": topk.OP1_SQL,
        "op2_secret_scans": secrets.OP2_SQL,
        "op3_line_dedup": line_dedup.OP3_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op7_ngram_jaccard_join": ngram_join.OP7_SQL,
        "op8_chat_formatting": chat.OP8_SQL,
        "op11_vector_code_compression": vector_codes.OP11_SQL,
        "op13_conversation_prefix_trie": prefix_trie.OP13_SQL,
    }
