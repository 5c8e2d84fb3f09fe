"""Registered queries and the DuckDB statement each must agree with."""

from gate.base import ORACLE, QUERIES
from gate import artifacts, features, learning, market, portfolio, research, transform

__all__ = ["ORACLE", "QUERIES", "artifacts", "features", "learning", "market", "portfolio", "research", "transform"]
