"""Queries over the driver tables, and the SQL that checks them."""

from . import payloads, queries, upkeep  # noqa: F401  each adds its queries

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
