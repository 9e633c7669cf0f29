"""Every registered query of the engine with the SQL that checks it."""

from __future__ import annotations

from mnemospark.plans import audit_queries, capture_queries, gateway_queries, graph_queries, ingest_queries, lifecycle_queries, page_queries, recall_queries, search_queries, sequence_queries, stream_queries, taskgraph_queries, text_queries, update_queries, workspace_queries, world_queries

_GROUPS = (recall_queries, search_queries, graph_queries, text_queries, lifecycle_queries, sequence_queries, world_queries, workspace_queries, ingest_queries, capture_queries, audit_queries, update_queries, taskgraph_queries, gateway_queries, page_queries, stream_queries)

QUERIES: dict = {name: f for group in _GROUPS for name, f in group.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for group in _GROUPS for name, sql in group.ORACLE_SQL.items()}
