"""All queries of the core and their SQL."""

from __future__ import annotations

from . import dataset_queries  # noqa: F401  registers its queries beside the others
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
