"""The queries of this subpackage, by name, and the DuckDB SQL of those that SQL can state."""

from __future__ import annotations

from vellum.llm import chat, decontaminate, divergence, extract_html, packing, pii, quality, rules, runs, sharding, similarity, substring, toxicity

QUERIES = {f.__name__: f for f in (
    packing.op1_packing, substring.op2_substring_dedup, decontaminate.op3_benchmark_decontamination, sharding.op4_sharding, similarity.op5_ngram_jaccard_join, toxicity.op6_toxicity,
    chat.op7_chat_formatting, rules.op8_quality_rules, quality.op9_quality_classifier, extract_html.op10_html_extraction, pii.op11_personal_data, runs.op12_periodic_runs, divergence.op13_source_divergence)}
ORACLE = {"op2_substring_dedup": substring.ORACLE_SMALL.strip(), "op5_ngram_jaccard_join": similarity.ORACLE_SMALL.strip(), "op7_chat_formatting": chat.ORACLE_TURNS.strip(),
          "op12_periodic_runs": runs.ORACLE_SMALL.strip(), "op13_source_divergence": divergence.ORACLE.strip()}
