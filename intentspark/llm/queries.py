"""Registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from intentspark.llm.chat import OP11_SQL, op11_chat
from intentspark.llm.fingerprints import op4_fingerprints
from intentspark.llm.huffman import op7_huffman
from intentspark.llm.mixing import op9_mixing
from intentspark.llm.near_join import op1_near_join
from intentspark.llm.negatives import OP12_SQL, op12_negatives
from intentspark.llm.privacy import op3_privacy
from intentspark.llm.quality import op6_quality
from intentspark.llm.resampling import OP13_SQL, op13_resampling
from intentspark.llm.rules import op8_rules
from intentspark.llm.shards import op10_shards
from intentspark.llm.subwords import op2_subwords
from intentspark.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_near_join": op1_near_join,
    "op2_subwords": op2_subwords,
    "op3_privacy": op3_privacy,
    "op4_fingerprints": op4_fingerprints,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_huffman": op7_huffman,
    "op8_rules": op8_rules,
    "op9_mixing": op9_mixing,
    "op10_shards": op10_shards,
    "op11_chat": op11_chat,
    "op12_negatives": op12_negatives,
    "op13_resampling": op13_resampling,
}

#: DuckDB SQL by query, where SQL can express it.
ORACLE: dict[str, str] = {
    "op11_chat": OP11_SQL,
    "op12_negatives": OP12_SQL,
    "op13_resampling": OP13_SQL,
}
