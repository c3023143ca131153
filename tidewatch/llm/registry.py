"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["url_filter", "quality_rules", "secret_scan", "sequence_packing", "decontamination", "ngram_jaccard", "language_id", "html_text", "substring_dedup", "line_dedup", "fill_in_middle", "token_files", "prefix_trie"]
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"tidewatch.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
