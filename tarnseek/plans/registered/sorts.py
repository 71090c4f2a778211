"""Sorts, pages, top-k, cursors and totals."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tarnseek.operators.clauses import Compare, Equals, matching
from tarnseek.operators.ordering import page_after, page_rows, sort_keys, top
from tarnseek.plans.registered.registry import query
from tarnseek.plans.registered.tables import labelled, view
from tarnseek.plans.search import page_with_total, search_view

_LINE_TIE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"


def _page(name, table_name, order_by, page, size, columns, sql_order, where=None, sql_where="true", counted_ranges=False):
    """Register one sorted page; the order ends in the table's own key."""

    @query(
        name,
        f"SELECT {', '.join(columns)} FROM {table_name} WHERE {sql_where} "
        f"ORDER BY {sql_order} LIMIT {size} OFFSET {(page - 1) * size}",
    )
    def run(spark, sf_dir):
        found = search_view(
            view(spark, sf_dir, table_name), where, columns, order_by, page=page, size=size, counted_ranges=counted_ranges
        )
        return found.rows


_LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]
_ORDER = ["o_orderkey", "o_orderdate", "o_totalprice"]

_page(
    "sort_multi", "lineitem", ["l_quantity desc", "l_shipdate asc"], 1, 1000, _LINE,
    f"l_quantity DESC, l_shipdate, {_LINE_TIE}",
)
_page(
    "sort_string", "customer", ["c_mktsegment desc", "c_name"], 1, 500,
    ["c_custkey", "c_mktsegment", "c_name"], "c_mktsegment DESC, c_name, c_custkey",
)
_page("sort_date", "orders", ["o_orderdate desc"], 1, 1000, _ORDER, "o_orderdate DESC, o_orderkey")
_page("page_first", "orders", ["o_totalprice desc"], 1, 102, _ORDER, "o_totalprice DESC, o_orderkey")
_page("page_nth", "orders", ["o_totalprice desc"], 2, 15, _ORDER, "o_totalprice DESC, o_orderkey")
_page("page_default", "orders", [], 1, 15, _ORDER, "o_orderkey")
_page("page_past_the_end", "orders", ["o_totalprice"], 1000, 1000, _ORDER, "o_totalprice, o_orderkey")
_page(
    "page_deep", "lineitem", ["l_shipdate", "l_quantity desc"], 550, 100, _LINE,
    f"l_shipdate, l_quantity DESC, {_LINE_TIE}", counted_ranges=True,
)


@query(
    "sort_missing",
    "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id "
    "ORDER BY coalesce(l.quality, 0) DESC, coalesce(l.toxic, 0), d.doc_id LIMIT 400",
)
def sort_missing(spark, sf_dir):
    found = search_view(
        labelled(spark, sf_dir), None, ["doc_id", "quality", "toxic"], ["quality desc", "toxic"], size=400
    )
    return found.rows


@query(
    "topk",
    f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem "
    f"ORDER BY l_extendedprice DESC, {_LINE_TIE} LIMIT 50",
)
def topk(spark, sf_dir):
    lines = view(spark, sf_dir, "lineitem")
    best = top(lines.df, sort_keys(lines, ["l_extendedprice desc"]), 50)
    return best.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "page_after_cursor",
    "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders "
    "WHERE o_totalprice < 250000 OR (o_totalprice = 250000 AND o_orderkey > 100) "
    "ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def page_after_cursor(spark, sf_dir):
    orders = view(spark, sf_dir, "orders")
    keys = sort_keys(orders, ["o_totalprice desc"])
    return page_after(orders.df, keys, (250000.0, 100), 100).select(*_ORDER)


@query("count_hits", "SELECT count(*) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 25")
def count_hits(spark, sf_dir):
    where = Compare("l_shipdate", ">=", "1998-01-01") & Compare("l_quantity", ">", 25)
    hits = matching(view(spark, sf_dir, "lineitem"), where)
    return hits.df.agg(F.count(F.lit(1)).alias("total"))


@query(
    "page_with_total",
    "SELECT event_id, value, (SELECT count(*) FROM events WHERE event_type = 'click') AS total FROM events "
    "WHERE event_type = 'click' ORDER BY value DESC, event_id LIMIT 15 OFFSET 30",
)
def filtered_page_with_total(spark, sf_dir):
    events = view(spark, sf_dir, "events")
    found = search_view(
        events, Equals("event_type", "click"), ["event_id", "value"], ["value desc"], page=3, size=15
    )
    return page_with_total(found)


@query(
    "sort_rows_by_missing_string",
    "SELECT conv_id, turn, role FROM conversations ORDER BY role DESC NULLS LAST, conv_id, turn LIMIT 200",
)
def sort_rows_by_missing_string(spark, sf_dir):
    turns = view(spark, sf_dir, "conversations")
    return page_rows(turns.df, sort_keys(turns, ["role desc"]), 1, 200).select("conv_id", "turn", "role")


@query(
    "sort_missing_string",
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS source, lang FROM documents "
    "ORDER BY CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END NULLS FIRST, doc_id DESC LIMIT 150 OFFSET 150",
)
def sort_missing_string(spark, sf_dir):
    """A string that every fifth row lacks: those come first in an ascending order."""
    docs = view(spark, sf_dir, "documents")
    source = F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source")
    some = replace(docs, df=docs.df.select("doc_id", source, "lang"))
    return page_rows(some.df, sort_keys(some, ["source", "doc_id desc"]), 2, 150).select("doc_id", "source", "lang")
