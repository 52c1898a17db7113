"""Queries over the derived domain tables and the SQL they are held against."""

from __future__ import annotations

from cytofold.plans import queries
from cytofold.plans import queries_io as _io  # noqa: F401  (registers its queries)
from cytofold.plans import queries_model as _model  # noqa: F401


def all_queries() -> dict[str, queries.Query]:
    return dict(queries.QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(queries.ORACLES)
