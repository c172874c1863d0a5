"""Registered queries: each operator over the given tables, with DuckDB SQL to check it."""

from quillspan.catalog.registry import ORACLE, QUERIES

from quillspan.catalog import (  # noqa: F401  (each import registers its queries)
    context_queries, conversation_queries, corpus_queries, ingest_queries, label_queries, manifest_queries,
    memory_queries, outline_queries, policy_queries, search_queries, stream_queries, text_queries, web_queries,
)

__all__ = ["ORACLE", "QUERIES"]
