"""The registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import chain_queries, merge_queries, motif_queries, scan_queries, site_queries, warehouse_queries

_PARTS = (motif_queries, scan_queries, site_queries, chain_queries, merge_queries, warehouse_queries)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
