"""The queries of this subpackage for the driver: QUERIES[name](spark, sf_dir), and SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from .chat import ORACLE_OP2, op2_chat
from .jaccard import op10_jaccard
from .licenses import op8_licenses
from .lines import op6_lines
from .neighbours import op4_neighbours
from .packing import op5_packing
from .pieces import op1_pieces
from .quality import op9_quality
from .scoring import op7_scoring
from .suffixes import op3_suffixes

QUERIES = {
    "op1_pieces": op1_pieces,
    "op2_chat": op2_chat,
    "op3_suffixes": op3_suffixes,
    "op4_neighbours": op4_neighbours,
    "op5_packing": op5_packing,
    "op6_lines": op6_lines,
    "op7_scoring": op7_scoring,
    "op8_licenses": op8_licenses,
    "op9_quality": op9_quality,
    "op10_jaccard": op10_jaccard,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat": ORACLE_OP2,
}
