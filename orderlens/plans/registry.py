"""Every query by name, with its SQL where there is one."""

from . import consensus, consumers, decomposition, quality, relational, runs, stability, statistics, surfaces  # noqa: F401
from .contract import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
