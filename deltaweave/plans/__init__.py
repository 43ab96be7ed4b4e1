"""The library's own queries."""

from . import commit_queries, delta_queries, lookup_queries, record_queries, rule_queries, state_queries  # noqa: F401
from .registry import ORACLES, QUERIES
