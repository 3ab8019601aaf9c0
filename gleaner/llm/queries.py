"""The subpackage's queries and their SQL, for the driver's registry."""

from __future__ import annotations

from gleaner.llm import embedding_dedup, exact_dedup, fill_in_middle, html_extract, ngram_join, packing, pii, quality, sentencepiece_lattice, substring_dedup, toxicity, url_filter, vector_codes

QUERIES = {
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op4_sentencepiece": sentencepiece_lattice.op4_sentencepiece,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op2_html_extraction": html_extract.op2_html_extraction,
    "op9_quality": quality.op9_quality,
    "op3_toxicity": toxicity.op3_toxicity,
    "op5_url_filter": url_filter.op5_url_filter,
    "op11_pii": pii.op11_pii,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

SQL = {
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_fill_in_middle": fill_in_middle.OP13_SQL,
}
