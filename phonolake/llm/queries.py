"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from phonolake.llm.importance import OP11_SQL, op11_importance
from phonolake.llm.language_id import op4_language_id
from phonolake.llm.line_dedup import OP6_SQL, op6_line_dedup
from phonolake.llm.media_columns import op7_media_columns
from phonolake.llm.ngram_join import OP1_SQL, op1_ngram_join
from phonolake.llm.pareto_mix import op9_mixing
from phonolake.llm.quality_classifier import op13_quality
from phonolake.llm.quality_rules import OP2_SQL, op2_quality_rules
from phonolake.llm.secret_scan import op5_secret_scan
from phonolake.llm.token_alignment import op12_alignment
from phonolake.llm.token_counts import op3_token_counts
from phonolake.llm.token_files import op8_token_files
from phonolake.llm.tree_bpe import op10_bpe

QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_quality_rules, op3_token_counts, op4_language_id, op5_secret_scan, op6_line_dedup, op7_media_columns, op8_token_files, op9_mixing, op10_bpe, op11_importance, op12_alignment, op13_quality)}
ORACLE_SQL = {"op1_ngram_join": OP1_SQL, "op2_quality_rules": OP2_SQL, "op6_line_dedup": OP6_SQL, "op11_importance": OP11_SQL}
