"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import op7_chat_formatting
from .filter_audit import op12_filter_audit
from .lexical_search import op11_lexical_search
from .licenses import op8_license_scan
from .mixing import op5_mixing
from .near_dedup import op1_near_dedup
from .oracles import ORACLE_SQL as ORACLE_SQL
from .pieces import op4_sentencepiece
from .sharding import op3_sharding
from .substring_dedup import op6_substring_dedup
from .toxicity import op2_toxicity
from .url_rules import op13_url_filters
from .vector_dedup import op9_vector_dedup
from .vector_search import op10_vector_search

QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_toxicity, op3_sharding, op4_sentencepiece, op5_mixing, op6_substring_dedup, op7_chat_formatting, op8_license_scan, op9_vector_dedup, op10_vector_search, op11_lexical_search, op12_filter_audit, op13_url_filters)}
