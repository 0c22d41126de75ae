"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from scriptorium.llm.chat_format import OP5_SQL, op5_chat_format
from scriptorium.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from scriptorium.llm.decontaminate import OP4_SQL, op4_decontaminate
from scriptorium.llm.line_dedup import op10_line_dedup
from scriptorium.llm.lm_score import op9_lm_score
from scriptorium.llm.mixing import op6_mixing
from scriptorium.llm.near_dedup import OP1_SQL, op1_near_dedup
from scriptorium.llm.neighbours import op7_neighbours
from scriptorium.llm.ngram_join import OP13_SQL, op13_ngram_join
from scriptorium.llm.quality import op8_quality
from scriptorium.llm.token_counts import op3_token_counts
from scriptorium.llm.toxicity import op2_toxicity
from scriptorium.llm.whitening import op12_whitening

QUERIES = {
    query.__name__: query
    for query in (
        op1_near_dedup, op2_toxicity, op3_token_counts, op4_decontaminate, op5_chat_format,
        op6_mixing, op7_neighbours, op8_quality, op9_lm_score, op10_line_dedup,
        op11_conversation_repair, op12_whitening, op13_ngram_join,
    )
}
ORACLES = {
    "op1_near_dedup": OP1_SQL, "op4_decontaminate": OP4_SQL, "op5_chat_format": OP5_SQL,
    "op11_conversation_repair": OP11_SQL, "op13_ngram_join": OP13_SQL,
}
