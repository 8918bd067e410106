"""All registered queries and their SQL checks."""

from __future__ import annotations

from crawlframe.plans import accounting_queries, corpus_queries, crawl_queries, search_queries, shop_queries, state_queries, stream_queries

_MODULES = (corpus_queries, state_queries, accounting_queries, search_queries, shop_queries, crawl_queries, stream_queries)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
