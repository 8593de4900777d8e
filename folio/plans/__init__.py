"""Registered queries; importing this package fills the registry."""

from folio.plans import bank_queries, block_queries, catalog_queries, layout_queries, question_queries, readable_queries, source_queries, stream_queries, structure_queries, text_queries, toc_queries, tree_queries  # noqa: F401
from folio.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
