"""The queries of this subpackage, by name, and SQL for those that it can express."""

from __future__ import annotations

from corpusloom.llm.ann import ORACLE_ANN, op3_ann
from corpusloom.llm.chat import ORACLE_CHAT, op4_chat
from corpusloom.llm.hnsw import ORACLE_HNSW, op6_hnsw
from corpusloom.llm.licenses import op10_licenses
from corpusloom.llm.minhash import ORACLE_MINHASH, op9_minhash
from corpusloom.llm.mixing import ORACLE_MIXING, op2_mixing
from corpusloom.llm.packing import ORACLE_PACKING, op5_packing
from corpusloom.llm.sharding import ORACLE_SHARDING, op7_sharding
from corpusloom.llm.suffix_dedup import op1_suffix_dedup
from corpusloom.llm.toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_mixing, op3_ann, op4_chat, op5_packing, op6_hnsw, op7_sharding, op8_toxicity, op9_minhash, op10_licenses)}
ORACLES = {"op2_mixing": ORACLE_MIXING, "op3_ann": ORACLE_ANN, "op4_chat": ORACLE_CHAT, "op5_packing": ORACLE_PACKING, "op6_hnsw": ORACLE_HNSW, "op7_sharding": ORACLE_SHARDING, "op9_minhash": ORACLE_MINHASH}
