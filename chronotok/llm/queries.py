"""Registry of the subpackage's queries: name -> (spark, sf_dir) builder, and oracle SQL where SQL can express it."""

from __future__ import annotations

from chronotok.llm import (
    decontaminate, html_extract, language_id, nearest_neighbours, packing, pii, quality_classifier, quality_rules, sharding,
    simhash, spelling_variants, substring_dedup, token_alignment)

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_histogram_sort": sharding.query,
    "op3_quality_rules": quality_rules.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_benchmark_decontamination": decontaminate.query,
    "op6_html_extraction": html_extract.query,
    "op7_language_id": language_id.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_pii": pii.query,
    "op10_simhash_pigeonring": simhash.query,
    "op11_spelling_variants": spelling_variants.query,
    "op12_nearest_neighbours": nearest_neighbours.query,
    "op13_token_alignment": token_alignment.query,
}

# DuckDB has no crc32, xxhash64 with a seed, tokenizer or zstandard; the other operators are held against brute force
# in the tests.
ORACLE: dict[str, str] = {"op3_quality_rules": quality_rules.ORACLE_SQL}
