"""The queries that apply each operator to its whole table, and the SQL that some can be held against."""

from __future__ import annotations

from driftwell.llm import jaccard, licences, mixing, vectors
from driftwell.llm.html import op1_html
from driftwell.llm.jaccard import op4_jaccard
from driftwell.llm.jpeg import op10_media
from driftwell.llm.licences import op9_licences
from driftwell.llm.lm import op3_lm
from driftwell.llm.mixing import op8_mixing
from driftwell.llm.pieces import op2_pieces
from driftwell.llm.pii import op5_pii
from driftwell.llm.quality import op7_quality
from driftwell.llm.vectors import op6_vectors

QUERIES = {
    "op1_html": op1_html,
    "op2_pieces": op2_pieces,
    "op3_lm": op3_lm,
    "op4_jaccard": op4_jaccard,
    "op5_pii": op5_pii,
    "op6_vectors": op6_vectors,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_licences": op9_licences,
    "op10_media": op10_media,
}
ORACLES: dict[str, str] = {"op4_jaccard": jaccard.SQL, "op6_vectors": vectors.SQL, "op8_mixing": mixing.SQL, "op9_licences": licences.SQL}
