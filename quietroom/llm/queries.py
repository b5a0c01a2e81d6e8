"""Gathers the queries of this subpackage and their SQL."""

from __future__ import annotations

from quietroom.llm import conversation_repair, decontamination, embedding_dedup, language_id  # noqa: F401
from quietroom.llm import line_dedup, nearest_neighbours, ngram_join, packing, quality  # noqa: F401
from quietroom.llm import sharding, spelling_variants, token_counts, warc  # noqa: F401
from quietroom.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
