"""All queries of the library's own operators."""

from __future__ import annotations

from . import place_queries, track_queries, twilight_queries, workflow_queries  # noqa: F401
from .register import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
