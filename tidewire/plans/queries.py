"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from tidewire.plans import catalog, catalog_messages, catalog_more, catalog_signals

__all__ = ["ORACLE", "QUERIES", "catalog_messages", "catalog_more", "catalog_signals"]

QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE
