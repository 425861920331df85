"""Every query of the core by name, with its SQL."""

from __future__ import annotations

from pampero.plans import datasets, reference, silver, surface  # noqa: F401  surface adds its queries to those of reference

QUERIES = dict(reference.QUERIES) | dict(silver.QUERIES) | dict(datasets.QUERIES)
SQL = dict(reference.SQL) | dict(silver.SQL) | dict(datasets.SQL)
