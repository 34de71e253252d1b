"""Every query of the library over the test tables, with its SQL twin."""

from __future__ import annotations

from geostrata.plans import consensus_queries, file_queries, listing_queries, mesh_queries, outline_queries, overlay_queries, raster_queries, vector_queries  # noqa: F401
from geostrata.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
