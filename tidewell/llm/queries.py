"""The queries of this subpackage, for __spark_entry__.py."""

from .alignment import op13_token_alignment
from .filter_audit import OP11_SQL, op11_filter_audit
from .language_id import op7_language_id
from .mixing import op12_source_mix
from .near_dups import op3_near_duplicates
from .packing import op9_best_fit_packing
from .secret_scan import op2_secret_scan
from .text_search import OP5_SQL, op5_text_search
from .token_counts import op4_token_counts
from .token_files import op1_token_files
from .transducer import op6_transducer
from .url_rules import op10_url_rules
from .vector_dups import op8_vector_duplicates

QUERIES = {f.__name__: f for f in (op1_token_files, op2_secret_scan, op3_near_duplicates, op4_token_counts, op5_text_search, op6_transducer, op7_language_id, op8_vector_duplicates, op9_best_fit_packing, op10_url_rules, op11_filter_audit, op12_source_mix, op13_token_alignment)}
ORACLE_SQL: dict[str, str] = {"op5_text_search": OP5_SQL, "op11_filter_audit": OP11_SQL}
