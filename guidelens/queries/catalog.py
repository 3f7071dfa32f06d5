"""All queries of the amplicon engine."""

from . import documents, files, hard, results, scalars, tables  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
