"""All core queries with their SQL, gathered from the modules of this folder."""

from __future__ import annotations

from quillgraph.plans import chat_queries, entity_queries, graph_queries, metric_queries, pipeline_queries, reference_queries, stream_queries, text_queries, vector_queries

_MODULES = [graph_queries, vector_queries, entity_queries, text_queries, chat_queries, metric_queries, stream_queries, reference_queries, pipeline_queries]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
FLAGSHIP = "ppr_projected_chunks"
