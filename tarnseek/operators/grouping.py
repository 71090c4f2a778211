"""Group counts: one group column, its row count, head row and members.

Counts use map-side partial aggregation, so a group holding a third of all rows
sends one partial row per task. Heads keep one row per group and task before
the shuffle. Members are laid out by sorting, never by collecting a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnseek.errors import TarnseekError
from tarnseek.operators.ordering import SortKey, check_page, is_deep, ordered, parse_order, range_holding, slice_rows, sort_keys
from tarnseek.operators.view import TableView
from tarnseek.schema import ROW_ID, Field
from tarnseek.sources.storage import work_folder


def group_field(view: TableView, group_by: str | Sequence[str]) -> Field:
    names = [group_by] if isinstance(group_by, str) else list(group_by)
    if len(names) != 1:
        raise TarnseekError("only one group field is supported")
    field = view.spec.field(names[0])
    if not field.kind.is_sortable:
        raise TarnseekError(f"column[{field.name}] is not supported in a group")
    return field


def count_name(taken: Sequence[str], name: str = "count") -> str:
    """``count``, with low lines put before it until no column has the name."""
    while name in taken:
        name = "_" + name
    return name


def split_order(group: str, order_by: Sequence) -> tuple[list, list]:
    """Order terms on the group column sort groups; the others sort inside groups."""
    terms = [parse_order(t) for t in order_by]
    return [t for t in terms if t[0] == group], [t for t in terms if t[0] != group]


def group_counts(view: TableView, group_by: str) -> DataFrame:
    """Each value of the group column with its number of rows; missing values form one group."""
    name = group_field(view, group_by).name
    return view.df.groupBy(name).agg(F.count(F.lit(1)).alias(count_name([name])))


def ordered_groups(view: TableView, group_by: str, order_by: Sequence = ()) -> DataFrame:
    """Groups in the order asked for; without one, best score first, then earliest row."""
    name = group_field(view, group_by).name
    groups, _ = split_order(name, order_by)
    if groups:
        return ordered(group_counts(view, name), _group_keys(view, name, groups))
    count = F.count(F.lit(1)).alias(count_name([name]))
    best = F.max("_score") if "_score" in view.df.columns else F.lit(1.0)
    first_row = F.min(_arrival(view))
    ranked = view.df.groupBy(name).agg(count, best.alias("_best"), first_row.alias("_first"))
    return ranked.orderBy(F.desc("_best"), "_first").drop("_best", "_first")


def _arrival(view: TableView) -> Column:
    """When a row came, as one value; a number where it can be, so that groups are hashed."""
    if view.tie == ROW_ID:
        batch, row = (F.col(c) for c in view.tie)
        rows_per_batch = F.lit(str(2**63)).cast("decimal(19,0)")
        return (batch.cast("decimal(18,0)") * rows_per_batch + row).cast("decimal(38,0)")
    return F.col(view.tie[0]) if len(view.tie) == 1 else F.struct(*view.tie)


def _group_keys(view: TableView, name: str, groups: list) -> list[SortKey]:
    """Sort groups by value; a missing number sorts like 0 yet stays apart from real zeros."""
    return [*sort_keys(view, groups[-1:], tie=False), SortKey(F.col(name).isNotNull())]


def group_total(view: TableView, group_by: str) -> DataFrame:
    """Number of groups, the group of missing values included."""
    name = group_field(view, group_by).name
    return view.df.select(name).distinct().agg(F.count(F.lit(1)).alias("total"))


def group_heads(view: TableView, group_by: str, order_by: Sequence = ()) -> DataFrame:
    """The first row of each group under the order inside groups."""
    name = group_field(view, group_by).name
    _, inside = split_order(name, order_by)
    keys = sort_keys(view, inside)
    if not inside and "_score" in view.df.columns:
        keys = [SortKey(F.col("_score"), True), *keys]
    window = Window.partitionBy(name).orderBy(*[k.order() for k in keys])
    return view.df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def group_members(
    view: TableView, group_by: str, order_by: Sequence = (), page: int = 1, size: int = 15, by_offsets: bool | None = None
) -> DataFrame:
    """Rows laid out group by group, cut into pages that run on across groups.

    A page near the beginning is one top-k of all rows up to its end. Far in (see ``page_rows``), or with ``by_offsets``, groups are
    counted first, and added up in their order to the offsets of the page: only rows of the groups between are read and sorted,
    in counted ranges where a group is large. That runs when the page is asked for; the counts are a table in the session's shared folder.
    """
    field = group_field(view, group_by)
    groups, inside = split_order(field.name, order_by)
    of_groups = _group_keys(view, field.name, groups or [(field.name, False)])
    keys = [*of_groups, *sort_keys(view, inside)]
    check_page(page, size)
    skip = (page - 1) * size
    if not (is_deep(skip, size) if by_offsets is None else by_offsets):
        return slice_rows(view.df, keys, skip, size, counted_ranges=False)
    name = count_name([field.name])
    path = work_folder(view.df.sparkSession, "group-counts")
    group_counts(view, field.name).write.parquet(path)
    counts = view.df.sparkSession.read.parquet(path)
    start = range_holding(counts, of_groups, skip, F.col(name))
    if start is None:
        return view.df.limit(0)
    end = range_holding(counts, of_groups, min(skip + size, start.total) - 1, F.col(name))
    between = end.upto(start.onwards(view.df, of_groups), of_groups)
    return slice_rows(between, keys, skip - start.before, size, counted_ranges=True)
