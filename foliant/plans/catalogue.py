"""Every registered query with its SQL twin."""

from __future__ import annotations

from . import q_documents, q_fields, q_quality, q_reading, q_tables

_PARTS = (q_reading, q_fields, q_tables, q_documents, q_quality)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in _PARTS:
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
