"""Registry of the engine's own queries."""

from __future__ import annotations

from folio.plans import curation as _curation  # noqa: F401  registers its queries
from folio.plans import jobs as _jobs  # noqa: F401  registers its queries
from folio.plans import steps as _steps  # noqa: F401  registers its queries
from folio.plans.queries import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
