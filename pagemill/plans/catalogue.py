"""All document and answer queries, and their SQL."""

from __future__ import annotations

from pagemill.plans import answers, ingestion, operations, retrieval

MODULES = [retrieval, ingestion, answers, operations]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
