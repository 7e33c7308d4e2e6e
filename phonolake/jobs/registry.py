"""All registered queries of the library and their SQL."""

from __future__ import annotations

from phonolake.jobs import frame_queries, model_queries, signal_queries, speech_queries, text_queries

_MODULES = (signal_queries, frame_queries, model_queries, text_queries, speech_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
