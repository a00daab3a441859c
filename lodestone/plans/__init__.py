"""Registered queries."""

from lodestone.plans import assembly_queries, conversation_queries, edit_queries, ingestion_queries, listing_queries, relational_queries, retrieval_queries, search_queries, streaming_queries, turn_queries  # noqa: F401
from lodestone.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
