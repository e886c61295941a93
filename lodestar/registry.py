"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from lodestar.queries import catalog, graphs, pipelines, scored, tables


def queries() -> dict:
    return dict(scored.QUERIES | graphs.QUERIES | pipelines.QUERIES | tables.QUERIES)


def oracle_sql() -> dict:
    return dict(catalog.ORACLES)
