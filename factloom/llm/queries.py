"""Named queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, codes, extract, line_dedup, mixing, near_vectors, periods, pieces, repeats, shingle_join, toxicity, url_filter, warc

QUERIES = {
    "op1_html_extraction": extract.op1_html_extraction,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_nearest_neighbours": ann.op4_nearest_neighbours,
    "op5_embedding_near_dedup": near_vectors.op5_embedding_near_dedup,
    "op6_ngram_jaccard": shingle_join.op6_ngram_jaccard,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_warc": warc.op8_warc,
    "op9_suffix_dedup": repeats.op9_suffix_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_periodic_runs": periods.op11_periodic_runs,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_vector_codes": codes.op13_vector_codes,
}

ORACLES = {
    "op8_warc": warc.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op12_line_dedup": line_dedup.ORACLE,
    "op13_vector_codes": codes.ORACLE,
}
