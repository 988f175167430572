"""The queries of this subpackage and, where SQL can express them, their SQL."""

from .lines import op5_lines
from .mixing import OP8_SQL, op8_mixing
from .mtree import OP4_SQL, op4_top_k
from .near import OP3_SQL, op3_near_duplicates
from .packing import op9_packing
from .personal import op10_personal
from .quality import op6_quality
from .scoring import op1_scores
from .tokens import op2_token_counts
from .warc import OP7_SQL, op7_warc

QUERIES = {f.__name__: f for f in (op1_scores, op2_token_counts, op3_near_duplicates, op4_top_k, op5_lines, op6_quality, op7_warc, op8_mixing, op9_packing, op10_personal)}
ORACLES = {"op3_near_duplicates": OP3_SQL, "op4_top_k": OP4_SQL, "op7_warc": OP7_SQL, "op8_mixing": OP8_SQL}
