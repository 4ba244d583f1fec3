"""The queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from graphloom.llm.bpe import op3_bpe
from graphloom.llm.chat import OP8_SQL, op8_chat
from graphloom.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from graphloom.llm.hmm_lm import op1_hmm_lm
from graphloom.llm.near_dedup import op9_near_dedup
from graphloom.llm.outliers import op7_outliers
from graphloom.llm.packing import op10_packing
from graphloom.llm.pii import op5_pii
from graphloom.llm.quality import op6_quality
from graphloom.llm.toxicity import op2_toxicity

QUERIES = {"op1_hmm_lm": op1_hmm_lm, "op2_toxicity": op2_toxicity, "op3_bpe": op3_bpe, "op4_exact_dedup": op4_exact_dedup, "op5_pii": op5_pii, "op6_quality": op6_quality, "op7_outliers": op7_outliers, "op8_chat": op8_chat, "op9_near_dedup": op9_near_dedup, "op10_packing": op10_packing}
ORACLES: dict[str, str] = {"op4_exact_dedup": OP4_SQL, "op8_chat": OP8_SQL}
