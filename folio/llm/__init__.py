"""Operators for building training corpora, and their registered queries."""

from folio.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
