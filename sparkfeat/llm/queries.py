"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, graph_dedup, link_trust, ngram_join, pii, reply_trees, substring_dedup, suffix_dedup, toxicity

_MODULES = (ngram_join, pii, link_trust, graph_dedup, bpe, substring_dedup, decontaminate, suffix_dedup, toxicity, reply_trees)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
