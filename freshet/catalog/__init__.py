"""Every operator as a query over the given tables, with an equivalent SQL text where one exists."""

from freshet.catalog import aggregates, cleaning, clocks, files, linking, panels, plans, streams, vectors, windows  # noqa: F401
from freshet.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
