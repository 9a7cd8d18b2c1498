"""Queries of the corpus operators and, where SQL can express one, the SQL."""

from plumbline.llm import collocation, exact_dedup, html, langid, media, mixing, near_dedup, pii, substring_dedup, subword, toxicity, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_sentencepiece": subword.op4_sentencepiece,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_html": html.op6_html,
    "op7_media": media.op7_media,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_pii": pii.op10_pii,
    "op11_language": langid.op11_language,
    "op12_collocations": collocation.op12_collocations,
}
ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_url_filter": url_filter.OP3_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op12_collocations": collocation.OP12_SQL,
}
