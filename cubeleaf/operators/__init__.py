"""Relational operators over tables: selection, grouping, joins and changes."""

from .dml import delete, insert, update
from .groupby import groupby
from .join import join
from .query import concat, query

__all__ = ["concat", "delete", "groupby", "insert", "join", "query", "update"]
