"""All queries and their SQL, gathered from the modules of this package."""

from . import bindings, catalog_queries, layout_queries, memory_queries, metadata_queries, retrieval_queries, text_queries, trend_queries, works_queries

QUERIES, ORACLES = bindings.QUERIES, bindings.ORACLES
__all__ = ["ORACLES", "QUERIES", "catalog_queries", "layout_queries", "memory_queries", "metadata_queries", "retrieval_queries", "text_queries", "trend_queries", "works_queries"]
