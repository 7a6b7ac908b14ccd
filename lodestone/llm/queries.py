"""The queries of this package by name, and their SQL where SQL can express them."""

from lodestone.llm.collision_search import op7_collision_search
from lodestone.llm.ngram_join import OP3_SQL, op3_ngram_join
from lodestone.llm.piece_nbest import op10_piece_nbest
from lodestone.llm.pii import op8_pii
from lodestone.llm.quality_rules import OP1_SQL, op1_quality_rules
from lodestone.llm.secret_scans import op4_secret_scans
from lodestone.llm.source_mixing import op9_source_mixing
from lodestone.llm.token_counts import op6_token_counts
from lodestone.llm.toxicity import op2_toxicity
from lodestone.llm.url_filters import op5_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_toxicity,
        op3_ngram_join,
        op4_secret_scans,
        op5_url_filters,
        op6_token_counts,
        op7_collision_search,
        op8_pii,
        op9_source_mixing,
        op10_piece_nbest,
    )
}
SQL = {"op1_quality_rules": OP1_SQL, "op3_ngram_join": OP3_SQL}
