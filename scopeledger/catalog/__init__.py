"""Registered queries over the test tables and their SQL equivalents."""

from scopeledger.catalog import (  # noqa: F401  (importing registers)
    facts, finance, forecast, kpis, quality, reports, scalars, shapes,
)
from scopeledger.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
