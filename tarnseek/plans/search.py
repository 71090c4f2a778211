"""Search: filter, then rank or sort, page, group; with total and snapshot."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from tarnseek.errors import TarnseekError
from tarnseek.functions.jsonvals import decode_object, member, member_or_null_text, result_json
from tarnseek.operators.clauses import Clause, matching
from tarnseek.operators.indexed import IndexFigures, PostingsSource, measured, needs_token
from tarnseek.operators.grouping import group_field, group_total, ordered_groups, split_order
from tarnseek.operators.lookup import fetch_records, latest_records
from tarnseek.operators.ordering import (
    DEFAULT_PAGE_SIZE,
    SortKey,
    check_page,
    ordered,
    page_rows,
    sort_keys,
)
from tarnseek.operators.relevance import ranks_by_score, scored
from tarnseek.operators.score_bounds import bounded
from tarnseek.operators.single_pass import hits_once
from tarnseek.operators.view import TableView
from tarnseek.schema import KEY_COLUMNS
from tarnseek.sources.decode import typed
from tarnseek.sources.storage import work_folder


@dataclass(frozen=True)
class SearchResult:
    """``rows`` is the page (or the groups); ``total`` counts all hits (or groups)."""

    rows: DataFrame
    counted: DataFrame
    snapshot: int | None = None
    page_size: int | None = None

    @cached_property
    def total(self) -> int:
        """Counted by a query of its own that reads only the filter's columns."""
        return self.counted.first()["total"]

    def json_rows(self) -> DataFrame:
        """Each result row as one JSON text, to be written by the executors."""
        return self.rows.select(result_json(self.rows.columns).alias("json"))

    def envelope(self) -> str:
        """A page as one JSON text, held by the driver. Answers without a size, groups among them, go through ``write_answer``."""
        if self.page_size is None:
            raise TarnseekError("the answer has no page size, so the driver can't hold it; use write_answer(path)")
        answer = {
            "total": self.total,
            "results": [json.loads(r["json"]) for r in self.json_rows().collect()],
            "success": True,
        }
        if self.snapshot is not None:
            answer["key"] = self.snapshot
        return json.dumps(answer, ensure_ascii=False)

    def write_answer(self, path: str) -> None:
        """The whole answer, whatever its size, written by the executors to a new folder.

        ``results`` has one JSON text per row, in order of the part files; ``total`` has one row with total, success and key.
        """
        key = [] if self.snapshot is None else [F.lit(self.snapshot).alias("key")]
        self.json_rows().write.text(f"{path}/results")
        self.counted.select("total", F.lit(True).alias("success"), *key).write.json(f"{path}/total")


def search_view(
    view: TableView,
    where: Clause | None = None,
    select: Sequence[str] | None = None,
    order_by: Sequence = (),
    group_by: str | None = None,
    page: int = 1,
    size: int | None = DEFAULT_PAGE_SIZE,
    counted_ranges: bool | None = None,
    records: DataFrame | None = None,
    version: str | None = None,
    missing_as_text: bool = False,
    rounded_lengths: bool = False,
    snapshot: int | None = None,
    indexes: Mapping[str, PostingsSource] | None = None,
    single_pass: bool = False,
    score_bounds: bool = False,
) -> SearchResult:
    """Search one table.

    ``select`` names declared fields or any member of the JSON value; none
    means all declared fields. Without ``order_by`` hits are ranked by score.
    ``records`` is the current record store: values are then fetched from it by
    key, and hits whose record is gone are left out of the rows, not of the
    total; with ``version``, a column of it, the newest record of a key counts. A page with values to fetch is worked
    out at once, so that its keys reach the scan of the values. ``indexes`` are stored postings by TEXT field; they're used where
    they can drive the search. Without a ``size`` all hits are given, in order. ``counted_ranges`` finds a page by counting,
    as is done for pages far in (see ``page_rows``). ``single_pass`` runs the search at once and reads the table once for rows, total and figures (see
    ``hits_once``); else each is a query of its own, run when asked for. It doesn't go with stored postings that can drive the search. With those, ``score_bounds`` finds at once which
    rows can reach a ranked page, and only they are joined and scored (see ``score_bounds.bounded``); the total still counts all.
    """
    if size is not None:
        check_page(page, size)
    if group_by is None:
        in_order = bool(order_by)
    else:
        in_order = bool(split_order(group_field(view, group_by).name, order_by)[0])
    ranked = not in_order and ranks_by_score(view, where)
    rows, figures, seen, reach = view, None, None, None
    if where is not None and set(where.text_fields(view)) <= set(indexes or ()) and needs_token(where, view):
        rows = measured(view, where, indexes)
        figures = IndexFigures(view, where, indexes) if ranked else None
        if score_bounds and ranked and size is not None and group_by is None:
            reach = bounded(view, where, indexes, page * size, rounded_lengths)
    elif single_pass and where is not None:
        keep = view.spec.field_names if select is None else select
        rows, figures, seen = hits_once(view, where, keep, ranked)
    if ranked:
        hits = scored(rows, where, rounded_lengths, figures, seen is not None)
    else:
        hits = rows if seen is not None else matching(rows, where)
    if group_by is not None:
        return SearchResult(
            ordered_groups(hits, group_by, order_by), group_total(hits, group_by), snapshot
        )
    # Scores and projected columns are pruned from the count.
    counted = hits.df.agg(F.count(F.lit(1)).alias("total"))
    if seen is not None:
        counted = hits.df.sparkSession.range(1).select(F.lit(seen).cast("long").alias("total"))
    if reach is not None:
        sources, known = reach
        hits = scored(measured(view, where, sources), where, rounded_lengths, known)
    keys = sort_keys(hits, order_by)
    if ranked:
        keys = [SortKey(F.col("_score"), True), *keys]
    names = list(dict.fromkeys(select or view.spec.field_names))
    dynamic = [n for n in names if not view.spec.has(n)]
    if records is None and not dynamic and not missing_as_text:
        found = _page(hits.df, keys, page, size, counted_ranges).select(*names)
    else:
        found = _fetched_page(view, hits, keys, page, size, counted_ranges, names, records, version, missing_as_text)
    return SearchResult(found, counted, snapshot, size)


def _page(df: DataFrame, keys, page: int, size: int | None, counted_ranges: bool | None) -> DataFrame:
    return ordered(df, keys) if size is None else page_rows(df, keys, page, size, counted_ranges)


#: Keys of a page that are given to the scan of its values one by one; with more, the join alone picks them.
KEYS_PUSHED = 1_000


def _of_page(raw: DataFrame, page: DataFrame, on: Sequence[str]) -> DataFrame:
    """``raw`` without rows that can't be the page's, by its keys as literals. The page is a written table of its size."""
    keys = page.select(*on).distinct().limit(KEYS_PUSHED + 1).collect()
    if len(keys) > KEYS_PUSHED:
        return raw
    for column in on:
        raw = raw.where(F.col(column).isin(sorted({k[column] for k in keys if k[column] is not None})))
    return raw


def _fetched_page(view, hits, keys, page, size, counted_ranges, names, records, version, missing_as_text) -> DataFrame:
    """Sort narrow rows first, then fetch the JSON values of the page alone."""
    if records is None:
        if "_value" not in view.df.columns:
            raise TarnseekError("the table keeps no JSON values, so only declared fields can be read")
        raw, on = view.df.select(*hits.tie, "_value"), list(hits.tie)
    else:
        on = [c for c in KEY_COLUMNS if c in records.columns]
        raw = records.select(*on, F.col("value").alias("_value"), *([version] if version else []))
    declared = [] if missing_as_text else [n for n in names if hits.spec.has(n)]
    if version:
        # What the record has now counts, also for declared fields.
        declared = []
    narrow = dict.fromkeys([*on, *declared])
    sorting = [k.column.alias(f"_k{i}") for i, k in enumerate(keys)]
    order = [SortKey(F.col(f"_k{i}"), k.descending) for i, k in enumerate(keys)]
    one_page = _page(hits.df.select(*narrow, *sorting), order, page, size, counted_ranges)
    if size is not None:
        path = work_folder(one_page.sparkSession, "page")
        one_page.write.parquet(path)
        one_page = one_page.sparkSession.read.schema(one_page.schema).parquet(path)
        raw = _of_page(raw, one_page, on)
    if version:
        raw = latest_records(raw, on, version).drop(version)
    found = fetch_records(one_page, raw, on)
    members = decode_object(F.col("_value"))
    read = member_or_null_text if missing_as_text else member
    shown = [F.col(n) if n in declared else _shown(hits.spec, members, n, read, version) for n in names]
    return ordered(found, order).select(*shown)


def _shown(spec, members, name: str, read, version) -> Column:
    """A member of the record; that of a declared field as its type, if the record is a current one."""
    if version and spec.has(name) and read is member:
        return typed(member(members, name), spec.field(name)).alias(name)
    return read(members, name).alias(name)


def page_with_total(result: SearchResult) -> DataFrame:
    """The page with the total beside each row, as one query."""
    return result.rows.withColumn("total", result.counted.scalar())

