"""All registered queries and their SQL."""

from . import code, corpus, facts, findings, graphs, knowledge, observed, relational, reports, retrieval, roles, streams  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
