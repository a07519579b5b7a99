"""All registered queries. Importing the modules registers what they hold."""

from batchkeeper.plans import (  # noqa: F401
    check_queries,
    history_queries,
    incident_queries,
    source_queries,
    stream_queries,
    table_queries,
)
from batchkeeper.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
