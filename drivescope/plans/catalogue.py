"""All registered queries; importing the modules fills the registry."""

from drivescope.plans import (  # noqa: F401
    catalog_queries,
    handover_queries,
    ingest_queries,
    neighbor_queries,
    scalar_queries,
    series_queries,
    session_queries,
    wide_queries,
)
from drivescope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
