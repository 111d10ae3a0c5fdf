"""Registered queries and the SQL they are checked against."""

from corvane.plans import corpus_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **corpus_queries.QUERIES}
ORACLES: dict = {**text_queries.ORACLES, **corpus_queries.ORACLES}
