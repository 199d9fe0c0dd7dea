"""Queries registered with the driver, each beside the SQL that states its result."""

from demandloom.registered import exact, joins, models, profiling, registry, rows, stores, streams, versioned
from demandloom.registered.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "exact", "joins", "models", "profiling", "registry", "rows", "stores", "streams", "versioned"]
