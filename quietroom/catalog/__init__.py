"""Every operator as a query over the given tables, with the SQL that checks it."""

from __future__ import annotations

from quietroom.catalog import (  # noqa: F401
    decisions,
    evaluation,
    features,
    fits,
    ingest,
    metrics,
    models,
    noise,
    streams,
    texts,
)
from quietroom.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
