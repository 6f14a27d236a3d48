"""All registered queries and their DuckDB oracle SQL."""

from __future__ import annotations

from . import q_build, q_combine, q_io, q_metrics, q_retrieval, q_stream, q_text

QUERIES: dict = {}
ORACLE: dict = {}
for _m in (q_text, q_retrieval, q_build, q_metrics, q_combine, q_io, q_stream):
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)
