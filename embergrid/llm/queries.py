"""The queries ``opN_<name>`` of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import op10_decontaminate
from .embedding_dedup import OP12_SQL, op12_embedding_dedup
from .filter_audit import OP11_SQL, op11_filter_audit
from .hmm_lm import op4_hmm_lm
from .html_extract import op8_html_extract
from .jaccard_join import OP9_SQL, op9_jaccard_join
from .language_id import op3_language_id
from .lexical_search import OP13_SQL, op13_lexical_search
from .packing import op7_packing
from .pii import op5_pii
from .quality import OP2_SQL, op2_quality
from .token_files import op6_token_files
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality": op2_quality,
    "op3_language_id": op3_language_id,
    "op4_hmm_lm": op4_hmm_lm,
    "op5_pii": op5_pii,
    "op6_token_files": op6_token_files,
    "op7_packing": op7_packing,
    "op8_html_extract": op8_html_extract,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontaminate": op10_decontaminate,
    "op11_filter_audit": op11_filter_audit,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL = {"op1_url_filter": OP1_SQL, "op2_quality": OP2_SQL, "op9_jaccard_join": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_embedding_dedup": OP12_SQL, "op13_lexical_search": OP13_SQL}
