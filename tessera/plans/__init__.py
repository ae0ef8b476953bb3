"""Registered queries on the driver's tables, with their SQL."""

from tessera.plans import catalog, claims, enrichment, gates, relational, selection, states, texts, transitions  # noqa: F401
from tessera.plans.registry import QUERIES, SQL  # noqa: F401
