"""Group counts, heads, orders and members."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnseek.operators.clauses import Compare, matching
from tarnseek.operators.grouping import (
    group_counts,
    group_heads,
    group_members,
    group_total,
    ordered_groups,
)
from tarnseek.plans.registered.registry import query
from tarnseek.plans.registered.tables import labelled, view


def _counts(name: str, table_name: str, column: str) -> None:
    @query(name, f'SELECT {column}, count(*) AS "count" FROM {table_name} GROUP BY {column}')
    def run(spark, sf_dir):
        return group_counts(view(spark, sf_dir, table_name), column)


_counts("group_count_string", "events", "event_type")
_counts("group_count_int", "part", "p_size")
_counts("group_count_long", "events", "user_id")
_counts("group_count_date", "orders", "o_orderdate")


@query(
    "group_count_missing",
    'SELECT l.quality, count(*) AS "count" FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1',
)
def group_count_missing(spark, sf_dir):
    return group_counts(labelled(spark, sf_dir), "quality")


@query(
    "group_count_ordered",
    'SELECT p_type, count(*) AS "count" FROM part WHERE p_size > 10 GROUP BY p_type ORDER BY p_type DESC',
)
def group_count_ordered(spark, sf_dir):
    hits = matching(view(spark, sf_dir, "part"), Compare("p_size", ">", 10))
    return ordered_groups(hits, "p_type", ["p_type desc", "p_size"])


@query(
    "group_count_by_first_row",
    'SELECT lang, count(*) AS "count" FROM documents GROUP BY lang ORDER BY min(doc_id)',
)
def group_count_by_first_row(spark, sf_dir):
    return ordered_groups(view(spark, sf_dir, "documents"), "lang")


@query(
    "group_total",
    "SELECT count(DISTINCT coalesce(l.quality, -1)) AS total FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def total_groups(spark, sf_dir):
    return group_total(labelled(spark, sf_dir), "quality")


@query(
    "group_head",
    """
    SELECT user_id, event_id, value, event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events
    ) WHERE r = 1
    """,
)
def heads(spark, sf_dir):
    found = group_heads(view(spark, sf_dir, "events"), "user_id", ["value desc"])
    return found.select("user_id", "event_id", "value", "event_type")


@query(
    "group_members_page",
    "SELECT event_type, event_id, value FROM events ORDER BY event_type DESC, value DESC, event_id "
    "LIMIT 1000 OFFSET 1500",
)
def members_page(spark, sf_dir):
    events = view(spark, sf_dir, "events")
    page = group_members(events, "event_type", ["event_type desc", "value desc"], page=4, size=500)
    return page.select("event_type", "event_id", "value").union(
        group_members(events, "event_type", ["event_type desc", "value desc"], page=5, size=500).select(
            "event_type", "event_id", "value"
        )
    )


@query(
    "group_members_deep_page",
    """
    SELECT * FROM (SELECT user_id, event_id, value, 1 AS page FROM events ORDER BY user_id, value DESC, event_id LIMIT 5)
    UNION ALL
    SELECT * FROM (SELECT user_id, event_id, value, 1000 AS page FROM events ORDER BY user_id, value DESC, event_id LIMIT 5 OFFSET 4995)
    """,
)
def members_deep_page(spark, sf_dir):
    """Pages 1 and 1000 by the offsets of the groups: only users on the page are read again."""
    events = view(spark, sf_dir, "events")
    pages = [
        group_members(events, "user_id", ["user_id", "value desc"], page=p, size=5, by_offsets=True)
        .select("user_id", "event_id", "value", F.lit(p).alias("page"))
        for p in (1, 1000)
    ]
    return pages[0].union(pages[1])
