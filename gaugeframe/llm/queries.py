"""The registered queries of this subpackage: name -> (callable(spark, sf_dir), SQL or None)."""

from __future__ import annotations

from gaugeframe.llm import decontaminate, language, near_dedup, neighbours, packing, quality, ranked_search, runs, secrets, seed_extend, suffix_dedup, token_count, toxicity

MODULES = (packing, token_count, quality, language, decontaminate, near_dedup, secrets, seed_extend, suffix_dedup, neighbours, runs, ranked_search, toxicity)
QUERIES = {name: pair for module in MODULES for name, pair in module.QUERIES.items()}
