"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import alignment, collocation, decontaminate, langid, lmscore, maintext, neardup, packing, quality, suffixdedup, tokens, urlfilter, warc

QUERIES = {
    "op1_suffix_dedup": suffixdedup.op1_suffix_dedup,
    "op2_near_dedup": neardup.op2_near_dedup,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_url_filter": urlfilter.op4_url_filter,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_warc": warc.op6_warc,
    "op7_language_id": langid.op7_language_id,
    "op8_lm_scoring": lmscore.op8_lm_scoring,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_packing": packing.op10_packing,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_collocations": collocation.op12_collocations,
    "op13_main_text": maintext.op13_main_text,
}

ORACLE_SQL: dict[str, str] = {**urlfilter.ORACLE, **decontaminate.ORACLE, **warc.ORACLE, **collocation.ORACLE}
