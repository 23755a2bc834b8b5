"""Registered queries: each operator over the given tables, with its check SQL."""

from apexline.plans import (  # noqa: F401
    archive, asof, ingest, notes, pits, results, sheets, streams, telemetry, timeline,
)
from apexline.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
