"""The registered queries: each operator run over whole tables, with the SQL to match."""

from tarnseek.plans.registered.registry import all_queries, all_sql
from tarnseek.plans.registered import (  # noqa: F401  (each module registers its queries)
    filters,
    groups,
    ingest,
    live,
    sorts,
    text,
)

__all__ = ["all_queries", "all_sql"]
