"""Registered queries over the provided tables, and their SQL."""

from . import block_queries, catalogue_queries, kernel_queries, signal_queries, small_queries, source_queries, stream_queries

PARTS = (catalogue_queries, signal_queries, kernel_queries, small_queries, source_queries, block_queries, stream_queries)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
