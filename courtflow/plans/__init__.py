"""Registered queries, grouped by the part of the work they belong to."""

from . import ball, geometry, labels, shots, streams, tables, teams, tracks  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
