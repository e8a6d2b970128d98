"""All queries outside the training-data operators, by name, and their DuckDB SQL."""

from __future__ import annotations

from weftline.plans import feed_queries, page_queries, stream_queries, web_queries

_MODULES = (feed_queries, web_queries, page_queries, stream_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
