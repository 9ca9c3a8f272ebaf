"""Registered queries of this package, with the DuckDB twin of those that SQL can express."""

from __future__ import annotations

from leadspark.llm import (byte_bpe, decontaminate, exact_dedup, hard_negatives, licenses, quality,
                           sentencepiece_codec, simhash, spelling, suffix_dedup, token_count, url_filter, warc)

QUERIES = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_quality": quality.op2_quality,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
    "op5_warc": warc.op5_warc,
    "op6_token_counts": token_count.op6_token_counts,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_licenses": licenses.op10_licenses,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

ORACLE_SQL = {
    "op1_url_filters": url_filter.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op5_warc": warc.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
