"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op5_nearest
from .ctw import op6_lm_score
from .decontaminate import OP10_SQL, op10_decontaminate
from .html import op2_html_text
from .mixing import op4_mixing
from .neardup import OP1_SQL, op1_near_duplicates
from .pii import op7_personal_data
from .quality import op8_quality
from .sharding import OP3_SQL, op3_shards
from .tokens import op9_token_counts

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_html_text": op2_html_text,
    "op3_shards": op3_shards,
    "op4_mixing": op4_mixing,
    "op5_nearest": op5_nearest,
    "op6_lm_score": op6_lm_score,
    "op7_personal_data": op7_personal_data,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_decontaminate": op10_decontaminate,
}
SQL = {
    "op1_near_duplicates": OP1_SQL,
    "op3_shards": OP3_SQL,
    "op10_decontaminate": OP10_SQL,
}
