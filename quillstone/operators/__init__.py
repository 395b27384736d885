"""Relational operators."""

from quillstone.operators.relational import Aggregate, Named, SortKey, aggregate, filter_rows, inner_join, limit_rows, project, sort_rows

__all__ = ["Aggregate", "Named", "SortKey", "aggregate", "filter_rows", "inner_join", "limit_rows", "project", "sort_rows"]
