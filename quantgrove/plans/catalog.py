"""All registered queries and their SQL."""

from __future__ import annotations

from quantgrove.plans import ingest, models  # noqa: F401
from quantgrove.plans.queries import QUERIES, SQL  # noqa: F401
