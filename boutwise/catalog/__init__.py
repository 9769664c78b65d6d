"""Registered queries and their SQL twins."""

from boutwise.catalog import (  # noqa: F401
    aggregates, expressions, jobs, joins, learning, sorting, sources, streams, windows,
)
from boutwise.catalog.registry import ORACLES, QUERIES  # noqa: F401
