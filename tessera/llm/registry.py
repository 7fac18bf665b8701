"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, decontamination, line_dedup, mtree, ngram_join, secret_scan, sharding, substring_dedup, toxicity, url_filter

_MODULES = (toxicity, bpe, substring_dedup, url_filter, decontamination, line_dedup, mtree, ngram_join, sharding, secret_scan)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
