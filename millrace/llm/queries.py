"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from millrace.llm.bpe import op1_byte_bpe
from millrace.llm.decontamination import OP8_SQL, op8_decontamination
from millrace.llm.fertility import op3_fertility
from millrace.llm.filter_audit import OP13_SQL, op13_filter_audit
from millrace.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from millrace.llm.langid import op10_language_id
from millrace.llm.lm import op6_attention_lm
from millrace.llm.ngram_join import OP4_SQL, op4_ngram_join
from millrace.llm.quotation import OP9_SQL, op9_quotation
from millrace.llm.sharding import OP5_SQL, SMALL_SHARDS_SQL, op5_sharding, small_shards
from millrace.llm.substring_dedup import op7_substring_dedup
from millrace.llm.suffix_dedup import op2_suffix_dedup
from millrace.llm.token_counts import op12_token_counts

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_fertility": op3_fertility,
    "op4_ngram_join": op4_ngram_join,
    "op5_sharding": op5_sharding,
    "op6_attention_lm": op6_attention_lm,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_quotation": op9_quotation,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_filter_audit": op13_filter_audit,
    "small_shards": small_shards,
}
ORACLE_SQL = {"op4_ngram_join": OP4_SQL, "op5_sharding": OP5_SQL, "small_shards": SMALL_SHARDS_SQL, "op8_decontamination": OP8_SQL, "op9_quotation": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op13_filter_audit": OP13_SQL}
