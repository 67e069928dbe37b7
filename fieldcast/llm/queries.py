"""The queries of this folder, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from fieldcast.llm import byte_bpe, chat, decontaminate, language_id, line_dedup, near_dedup, quality, ranked_search, repair, sentencepiece, token_counts, toxicity, url_filter

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_sentencepiece": sentencepiece.op4_sentencepiece,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}
SQL = {
    "op2_decontamination": decontaminate.OP2_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op11_conversation_repair": repair.OP11_SQL,
    "op13_ranked_search": ranked_search.OP13_SQL,
}
