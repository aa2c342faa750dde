"""All registered queries with their SQL counterparts."""

from fleetcast.catalog.base import ORACLES, QUERIES
from fleetcast.catalog import (  # noqa: F401
    accuracy, arima_queries, calendar_joins, ensembles, exploration, files, fleet, ingest, linear, smoothing,
)

__all__ = ["QUERIES", "ORACLES"]
