"""Every query of the engine outside the corpus operators, with its DuckDB counterpart."""

from __future__ import annotations

from .plans import registry, relational, scalars, searches  # noqa: F401

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
