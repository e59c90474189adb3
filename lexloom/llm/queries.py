"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lexloom.llm.packing import op3_best_fit_packing
from lexloom.llm.simhash import op2_simhash
from lexloom.llm.winnowing import op5_winnowing
from lexloom.llm.toxicity import op10_toxicity
from lexloom.llm.embedding_dedup import op9_embedding_dedup
from lexloom.llm.exponion import clusters_sql, op13_exponion
from lexloom.llm.gru_lm import op6_gru_lm
from lexloom.llm.mixing import op8_mixing
from lexloom.llm.prefix_trie import PREFIX_TRIE_SQL, op12_prefix_trie
from lexloom.llm.rule_lists import QUALITY_COUNTS_SQL, op11_rule_lists, quality_counts
from lexloom.llm.token_rollup import TOKEN_ROLLUP_WORDS_SQL, op7_token_rollup, token_rollup_words
from lexloom.llm.warc import op1_warc
from lexloom.llm.secret_scan import op4_secret_scan

QUERIES = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_winnowing": op5_winnowing,
    "op6_gru_lm": op6_gru_lm,
    "op7_token_rollup": op7_token_rollup,
    "token_rollup_words": token_rollup_words,
    "op8_mixing": op8_mixing,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_rule_lists": op11_rule_lists,
    "quality_counts": quality_counts,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_exponion": op13_exponion,
}

ORACLE_SQL: dict[str, str] = {"token_rollup_words": TOKEN_ROLLUP_WORDS_SQL, "quality_counts": QUALITY_COUNTS_SQL, "op12_prefix_trie": PREFIX_TRIE_SQL, "op13_exponion": clusters_sql()}
