"""Queries of this subpackage by name, and their DuckDB twins where SQL can express them."""

from .bloom_lm import op9_bloom_lm
from .centroids import OP13_SQL, op13_centroids
from .chat_format import OP4_PARTS_SQL, op4_chat_format
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .html_extract import op10_html_extract
from .jaccard_join import op8_jaccard_join
from .language_id import op7_language_id
from .merkle import OP11_SQL, op11_merkle
from .pii import op5_pii
from .quality_rules import op6_quality_rules
from .sentencepiece_nbest import op1_sentencepiece
from .source_mix import op3_source_mix
from .substrings import OP12_SQL, op12_substrings

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_source_mix": op3_source_mix,
    "op4_chat_format": op4_chat_format,
    "op5_pii": op5_pii,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_bloom_lm": op9_bloom_lm,
    "op10_html_extract": op10_html_extract,
    "op11_merkle": op11_merkle,
    "op12_substrings": op12_substrings,
    "op13_centroids": op13_centroids,
}
SQL = {"op2_exact_dedup": OP2_SQL, "op4_chat_format": OP4_PARTS_SQL, "op11_merkle": OP11_SQL, "op12_substrings": OP12_SQL, "op13_centroids": OP13_SQL}
