"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from rangeweave.plans import cluster, reads, routing, streams, writes  # noqa: F401  they register their queries
from rangeweave.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
