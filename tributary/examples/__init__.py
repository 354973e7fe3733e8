"""One example query per operator, with its oracle."""

from tributary.examples import exact, filters, groups, joins, projections, tables, trees  # noqa: F401
from tributary.examples.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
