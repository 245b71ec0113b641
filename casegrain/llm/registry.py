"""Queries of this subpackage, and their SQL."""

from __future__ import annotations

from casegrain.llm.decontamination import op2_decontaminate
from casegrain.llm.mixing import op1_mix_sources
from casegrain.llm.oracles import ORACLES
from casegrain.llm.pii import op8_pii
from casegrain.llm.quality import op4_quality
from casegrain.llm.rules import op6_quality_rules
from casegrain.llm.sharding import op7_shard
from casegrain.llm.simhash import op9_simhash
from casegrain.llm.substring_dedup import op10_substring_dedup
from casegrain.llm.toxicity import op5_toxicity
from casegrain.llm.warc import op3_warc

QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_decontaminate, op3_warc, op4_quality, op5_toxicity, op6_quality_rules, op7_shard, op8_pii, op9_simhash, op10_substring_dedup)}


__all__ = ["ORACLES", "QUERIES"]
