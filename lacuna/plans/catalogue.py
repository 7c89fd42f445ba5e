"""All queries over the engine's operators, with their SQL where SQL can express them."""

from __future__ import annotations

from . import catalogue_jobs, catalogue_kernels, catalogue_order, catalogue_series, catalogue_spectral, catalogue_tables

_PARTS = (catalogue_series, catalogue_tables, catalogue_spectral, catalogue_order, catalogue_jobs, catalogue_kernels)


def queries() -> dict:
    return {name: q for part in _PARTS for name, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
