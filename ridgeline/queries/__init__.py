"""The registered queries of the engine's own operators, and SQL that gives the same rows."""

from ridgeline.queries import causal, graphs, linear, nonlinear
from ridgeline.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "causal", "graphs", "linear", "nonlinear"]
