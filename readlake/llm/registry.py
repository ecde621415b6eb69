"""Queries and SQL of this subpackage, by name."""

from readlake.llm import decontaminate, language_id, lexical_search, line_dedup, mixing, near_dedup, pii, quality_classifier, quality_rules, substring_dedup, toxicity, turn_repair, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_private_data": pii.op5_private_data,
    "op6_language_id": language_id.op6_language_id,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_turn_repair": turn_repair.op11_turn_repair,
    "op12_warc": warc.op12_warc,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op2_near_dedup": near_dedup.ORACLE,
    "op3_quality_rules": quality_rules.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op11_turn_repair": turn_repair.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
