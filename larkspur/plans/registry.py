"""All queries of the reference's operators and their DuckDB twins."""

from larkspur.plans import answers, evaluation, files, indexes, search, serving, shaping, streams, structures, texts  # noqa: F401
from larkspur.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
