"""All driver-facing queries of the library and their SQL."""

from __future__ import annotations

from matlink.plans import harmonise, items, money, overview, records, serving

_MODULES = (money, items, records, harmonise, serving, overview)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
