"""All registered queries and their SQL, by name."""

from __future__ import annotations

from flowlab.plans import base, captures, flows, models, streams  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.ORACLES)
