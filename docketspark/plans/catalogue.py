"""All registered queries of the core, with their DuckDB twins."""

from __future__ import annotations

from docketspark.plans import analytics, feeds, more, problems, relational, scanning, search, streams, texts

_MODULES = [problems, relational, texts, analytics, search, more, scanning, feeds, streams]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: sql for m in _MODULES for k, sql in m.ORACLE.items()}
FLAGSHIP = "hybrid_search"
