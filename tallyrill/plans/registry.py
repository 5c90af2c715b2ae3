"""Queries of the listing engine and their DuckDB SQL."""

from . import listing_queries, more_queries, text_queries, training_queries  # noqa: F401  the others register with the first

QUERIES: dict = listing_queries.QUERIES
ORACLES: dict = listing_queries.ORACLES
