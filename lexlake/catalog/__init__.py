"""Registered queries: each operator over the given tables, with its SQL form."""

from lexlake.catalog import aggregated, cleaned, flows, joined, judged, reported, sampled, scanned, trained  # noqa: F401
from lexlake.catalog.base import REGISTRY

__all__ = ["REGISTRY"]
