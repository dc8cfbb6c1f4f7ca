"""Runnable queries: the operators bound to the provided tables.

A query comes with the SQL that must give the same rows, where SQL can say it.
"""

from tallymill.plans import (  # noqa: F401
    histories,
    layering,
    logging,
    reporting,
    running,
    storing,
    streams,
)
from tallymill.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
