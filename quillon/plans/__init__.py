"""Registered queries: importing this package fills the registry."""

from quillon.plans import answers, corpus, evaluation, files, parts, retrieval, stores, telemetry  # noqa: F401
from quillon.plans.registry import QUERIES, SQL, Tables

__all__ = ["QUERIES", "SQL", "Tables"]
