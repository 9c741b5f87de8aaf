"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ("pieces", "chat", "decontamination", "warc", "neural_lm", "suffix_dedup", "jaccard_join", "licenses", "resampling", "quality_rules")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"cairnlight.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
