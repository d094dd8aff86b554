"""Named queries over the given tables, one per operator, with their SQL counterparts."""

from demandspark.catalog.base import ORACLE, QUERIES
from demandspark.catalog import models, prices, series, stats, streams, tables

flagship = prices.flagship

__all__ = ["ORACLE", "QUERIES", "flagship", "models", "prices", "series", "stats", "streams", "tables"]
