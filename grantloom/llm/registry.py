"""The training-data queries and their SQL, for the entry module."""

from grantloom.llm.bpe import op5_bpe
from grantloom.llm.chat import OP4_SQL, op4_chat
from grantloom.llm.conversation_repair import OP12_SQL, op12_conversation_repair
from grantloom.llm.divergence import OP11_SQL, op11_source_divergence
from grantloom.llm.embedding_dups import op13_embedding_near_dups
from grantloom.llm.imatch import op1_imatch
from grantloom.llm.mixing import op2_mixing
from grantloom.llm.near_dups import op8_minhash
from grantloom.llm.pii import op10_pii
from grantloom.llm.quality_rules import OP9_SQL, op9_quality_rules
from grantloom.llm.substrings import op6_substring_dedup
from grantloom.llm.token_counts import op7_token_counts
from grantloom.llm.url_filter import op3_url_filter

QUERIES = {
    "op1_imatch": op1_imatch,
    "op2_mixing": op2_mixing,
    "op3_url_filter": op3_url_filter,
    "op4_chat": op4_chat,
    "op5_bpe": op5_bpe,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_minhash": op8_minhash,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii": op10_pii,
    "op11_source_divergence": op11_source_divergence,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_embedding_near_dups": op13_embedding_near_dups,
}
SQL = {"op4_chat": OP4_SQL, "op9_quality_rules": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_conversation_repair": OP12_SQL}
