"""All queries of the read, ingest, text and combat layers and their SQL."""

from __future__ import annotations

from sparrowlog.plans import combat_queries, ingest_queries, ingest_unit_queries, process_queries, read_queries, read_unit_queries, status_queries  # noqa: F401
from sparrowlog.plans.register import ORACLES, QUERIES  # noqa: F401
