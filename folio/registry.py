"""Every registered query of the library proper, by name, with its DuckDB SQL."""

from __future__ import annotations

from folio.plans import block_queries, catalogue_queries, job_queries  # noqa: F401  (they register)
from folio.plans.spec import ORACLE_SQL, QUERIES

FLAGSHIP = "chapter_report"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
