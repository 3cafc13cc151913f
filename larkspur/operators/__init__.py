"""Relational operators as DataFrame functions."""

from larkspur.operators.relational import aggregate, distinct, having, join, limit, ranked, scan, sort, top_k, values

__all__ = ["aggregate", "distinct", "having", "join", "limit", "ranked", "scan", "sort", "top_k", "values"]
