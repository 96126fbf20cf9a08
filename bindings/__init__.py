"""Queries over the driver's tables with their SQL twins: the operators bound to those column names."""

from . import aggregates, geo, jobs, relational, scalars, sources, windows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
