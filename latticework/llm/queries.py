"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op5_bpe
from .fingerprints import op1_fingerprints
from .langid import op10_language_id
from .line_dedup import OP4_SQL, PAGES_SQL, line_dedup_pages, op4_line_dedup
from .mixing import op2_mixing
from .ogg import op3_ogg
from .sharding import op9_sharding
from .simhash import op7_simhash
from .unigram import op6_token_counts
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_mixing": op2_mixing,
    "op3_ogg": op3_ogg,
    "op4_line_dedup": op4_line_dedup,
    "line_dedup_pages": line_dedup_pages,
    "op5_bpe": op5_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_sharding": op9_sharding,
    "op10_language_id": op10_language_id,
}

SQL = {"op4_line_dedup": OP4_SQL, "line_dedup_pages": PAGES_SQL, "op8_warc": OP8_SQL}
