"""Registered queries and the SQL that states their expected result."""

from driftpanel.queries import (  # noqa: F401  (importing registers)
    board_queries, drift_queries, ledger_queries, panel_queries, response_queries, setting_queries,
)
from driftpanel.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
