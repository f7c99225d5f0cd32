"""Registered queries; importing the modules below fills the registry."""

from tapeframe.plans import align_queries, grid_queries, link_queries, stream_queries
from tapeframe.plans.registry import COVERS, ORACLE_SQL, QUERIES

__all__ = ["COVERS", "ORACLE_SQL", "QUERIES", "align_queries", "grid_queries", "link_queries", "stream_queries"]
