"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .exact_dedup import OP9_SQL, op9_exact_dedup
from .fill_in_middle import OP13_SQL, op13_fill_in_middle
from .html_extract import op10_html_extract
from .language_id import op3_language_id
from .near_dedup import OP8_SQL, op8_near_dedup
from .packing import op6_best_fit_packing
from .pii import op5_pii
from .sentencepiece_codec import op2_sentencepiece
from .sharding import OP7_SQL, op7_sharding
from .toxicity import op11_toxicity
from .turn_repair import OP12_SQL, op12_turn_repair
from .url_filter import OP4_SQL, op4_url_filter
from .vector_dedup import OP1_SQL, op1_vector_dedup

QUERIES = {
    "op1_vector_dedup": op1_vector_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_language_id": op3_language_id,
    "op4_url_filter": op4_url_filter,
    "op5_pii": op5_pii,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_sharding": op7_sharding,
    "op8_near_dedup": op8_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_html_extract": op10_html_extract,
    "op11_toxicity": op11_toxicity,
    "op12_turn_repair": op12_turn_repair,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES = {"op1_vector_dedup": OP1_SQL, "op4_url_filter": OP4_SQL, "op7_sharding": OP7_SQL, "op8_near_dedup": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op12_turn_repair": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
