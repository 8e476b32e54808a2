"""Named queries over the test tables and the SQL that they must equal."""

from __future__ import annotations

from tessera.plans import queries_chain, queries_core, queries_series, queries_stats, queries_tiles

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (queries_core, queries_stats, queries_series, queries_chain, queries_tiles):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
