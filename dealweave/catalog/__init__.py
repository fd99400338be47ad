"""Named queries over the driver's tables, each with its check SQL where SQL can say the same."""

from dealweave.catalog.base import CHECKS, QUERIES
from dealweave.catalog import aggregates, entities, ingest, joins, keywords, reports, rowsets, scalars, search, sql_calls, streams  # noqa: F401

__all__ = ["CHECKS", "QUERIES"]
