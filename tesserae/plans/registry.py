"""Registered queries of the library and their reference SQL."""

from __future__ import annotations

from tesserae.plans import catalog_queries, pixel_queries, text_queries, workload_queries  # noqa: F401  each fills the book
from tesserae.plans.book import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
