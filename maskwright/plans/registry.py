"""All queries of the core package by name."""

from . import model_queries  # noqa: F401  registers its queries
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
