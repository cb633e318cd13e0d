"""One query per operator, over whole tables, and the SQL that DuckDB can check it with."""

from __future__ import annotations

from tripwire.llm import ann, bpe, collocations, exact_dedup, language_id, lexical_search, line_dedup, mixing, near_dedup, quality, resharding, token_orc, url_filter

LLM_QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_mixing": mixing.op2_mixing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_token_orc": token_orc.op6_token_orc,
    "op7_language_id": language_id.op7_language_id,
    "op8_quality": quality.op8_quality,
    "op9_ann": ann.op9_ann,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_resharding": resharding.op11_resharding,
    "op12_collocations": collocations.op12_collocations,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

LLM_ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op3_line_dedup": line_dedup.oracle(),
    "op4_url_filter": url_filter.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
