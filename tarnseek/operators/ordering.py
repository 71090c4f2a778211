"""Sort keys with the engine's rules for missing values, and pages of sorted rows.

A missing number sorts as 0 and a missing date as 1970-01-01; a missing string
comes first ascending and last descending. Every order ends in the view's tie
columns.
"""

from __future__ import annotations

import os.path
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tarnseek.errors import TarnseekError
from tarnseek.operators.view import TableView
from tarnseek.schema import Kind

DEFAULT_PAGE_SIZE = 15
# A counted range is split until it has at most this many rows. Pages that end later are found by counting.
RANGE_ROWS = 50_000
_SPLITS = 31


def plain_literal(value: object) -> Column:
    """A literal whose dates carry no time zone, like the columns they're compared with."""
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


@dataclass(frozen=True)
class SortKey:
    """One resolved key: a column whose NULLs come first ascending, last descending.

    With ``missing`` NULLs sort as that value instead. Tests compare the bare column, so that
    they reach the scan.
    """

    bare: Column
    descending: bool = False
    missing: object = None

    @property
    def column(self) -> Column:
        """What rows are sorted by."""
        if self.missing is None:
            return self.bare
        return F.coalesce(self.bare, plain_literal(self.missing))

    def order(self) -> Column:
        return self.column.desc_nulls_last() if self.descending else self.column.asc_nulls_first()

    def _side(self, value: object, later: bool) -> Column:
        """Rows strictly on one side of a value; NULL counts as false."""
        up = later != self.descending
        nulls_first = not self.descending
        if value is None:
            return F.lit(False) if later != nulls_first else self.bare.isNotNull()
        beyond = self.bare > plain_literal(value) if up else self.bare < plain_literal(value)
        if self.missing is not None:
            nulls = self.missing > value if up else self.missing < value
        else:
            nulls = later != nulls_first
        return beyond | self.bare.isNull() if nulls else beyond

    def after(self, value: object) -> Column:
        """Does a row come strictly after this value?"""
        return self._side(value, True)

    def before(self, value: object) -> Column:
        return self._side(value, False)

    def same(self, value: object) -> Column:
        if value is None:
            return self.bare.isNull()
        equal = self.bare == plain_literal(value)
        return equal | self.bare.isNull() if self.missing is not None and self.missing == value else equal


def parse_order(term: str | tuple[str, str] | tuple[str, bool]) -> tuple[str, bool]:
    """``"a"``, ``"a desc"``, ``("a", "desc")`` → name and whether descending."""
    name, way = (term.rsplit(" ", 1) if " " in term else (term, "asc")) if isinstance(term, str) else term
    if isinstance(way, str):
        if way.lower() not in ("asc", "desc"):
            raise TarnseekError(f"order [{term}] is neither asc nor desc")
        way = way.lower() == "desc"
    return name, way


def sort_keys(view: TableView, order_by: Sequence = (), tie: bool = True) -> list[SortKey]:
    keys = []
    for term in order_by:
        name, descending = parse_order(term)
        field = view.spec.field(name)
        if not field.kind.is_sortable:
            raise TarnseekError(f"column[{name}] is not supported in an order")
        missing = 0 if field.kind.is_number else datetime(1970, 1, 1) if field.kind is Kind.DATE else None
        keys.append(SortKey(F.col(name), descending, missing))
    if tie:
        keys += [SortKey(F.col(c)) for c in view.tie]
    return keys


def ordered(df: DataFrame, keys: Sequence[SortKey]) -> DataFrame:
    return df.orderBy(*[k.order() for k in keys])


def after_row(keys: Sequence[SortKey], values: Sequence) -> Column:
    """Rows strictly after the row with these key values, key by key."""
    condition = F.lit(False)
    for key, value in reversed(list(zip(keys, values, strict=True))):
        condition = key.after(value) | (key.same(value) & condition)
    return condition


def check_page(page: int, size: int) -> None:
    for what, n in (("page", page), ("size", size)):
        if isinstance(n, bool) or not isinstance(n, int) or n < 1:
            raise TarnseekError(f"{what} [{n!r}] is not a positive whole number")


def page_rows(
    df: DataFrame,
    keys: Sequence[SortKey],
    page: int = 1,
    size: int = DEFAULT_PAGE_SIZE,
    counted_ranges: bool | None = None,
) -> DataFrame:
    """Page ``page`` (from 1) of ``size`` rows; past the end it is empty.

    A page near the beginning is one top-k of all rows up to its end. One that ends after ``RANGE_ROWS`` rows
    is found by ``counted_ranges``: rows are counted in sorted ranges of exact sizes when the page is asked for, and only those
    between the ranges of its first and last row are sorted. The caller may ask for either. Both give the same page.
    """
    check_page(page, size)
    return slice_rows(df, keys, (page - 1) * size, size, counted_ranges)


def is_deep(skip: int, size: int) -> bool:
    """Are the rows up to the page's end too many for one task?"""
    return skip + size > RANGE_ROWS


def slice_rows(df: DataFrame, keys: Sequence[SortKey], skip: int, size: int, counted_ranges: bool | None = None) -> DataFrame:
    """``size`` rows after the first ``skip`` in order."""
    if not (is_deep(skip, size) if counted_ranges is None else counted_ranges):
        return ordered(df, keys).offset(skip).limit(size)
    start = range_holding(df, keys, skip)
    if start is None:
        return df.limit(0)
    end = range_holding(df, keys, min(skip + size, start.total) - 1)
    between = end.upto(start.onwards(df, keys), keys)
    return ordered(between, keys).offset(skip - start.before).limit(size)


@dataclass(frozen=True)
class SortedRange:
    """Neighbouring rows of the sort order.

    The first keys equal ``prefix``; the next one lies between ``low`` and
    ``high``, each a one-value tuple or empty for no bound, ends excluded.
    ``before`` rows come earlier.
    """

    prefix: tuple
    low: tuple
    high: tuple
    before: int
    rows: int
    total: int

    def select(self, df: DataFrame, keys: Sequence[SortKey]) -> DataFrame:
        """The rows of the range."""
        for key, value in zip(keys, self.prefix):
            df = df.where(key.same(value))
        for value in self.low:
            df = df.where(keys[len(self.prefix)].after(value))
        for value in self.high:
            df = df.where(keys[len(self.prefix)].before(value))
        return df

    def onwards(self, df: DataFrame, keys: Sequence[SortKey]) -> DataFrame:
        """The rows of the range and all later ones."""
        start = (*self.prefix, *self.low)
        if not start:
            return df
        later = after_row(keys[: len(start)], start)
        return df.where(later if self.low else later | _same_row(keys, self.prefix))

    def upto(self, df: DataFrame, keys: Sequence[SortKey]) -> DataFrame:
        """The rows of the range and all earlier ones."""
        end = (*self.prefix, *self.high)
        if not end:
            return df
        earlier = before_row(keys[: len(end)], end)
        return df.where(earlier if self.high else earlier | _same_row(keys, self.prefix))


def range_holding(df: DataFrame, keys: Sequence[SortKey], rank: int, weight: Column | None = None) -> SortedRange | None:
    """A sorted range of few rows that holds the row of this rank (from 0). With a ``weight``, each row counts as so many.

    Each round sketches one key over all rows of the part, counts the rows before, at and
    between the sketch's values exactly in one pass, and keeps the part with
    the rank. A value that many rows share becomes fixed and the next key is
    split. The sketch decides only where parts end; counts and rows are whole.
    Only split values and one count per part come to the driver.
    """
    many = F.count(F.lit(1)) if weight is None else F.sum(weight)
    total = df.agg(many.alias("n")).first()["n"] or 0
    if rank >= total:
        return None
    found = SortedRange((), (), (), 0, total, total)
    while found.rows > RANGE_ROWS and len(found.prefix) < len(keys):
        part, key = found.select(df, keys), keys[len(found.prefix)]
        splits = _split_values(part, key)
        # Slots: 0 before the first split, 1 at it, 2 between the first two, and so on.
        slot = sum(
            F.when(key.after(s), 2).when(key.same(s), 1).otherwise(0) for s in splits
        )
        counts = {r["slot"]: r["n"] for r in part.groupBy(slot.alias("slot")).agg(many.alias("n")).collect()}
        before, i = found.before, 0
        while before + counts.get(i, 0) <= rank:
            before += counts.get(i, 0)
            i += 1
        if i % 2:
            bounds = ((*found.prefix, splits[i // 2]), (), ())
        else:
            low = (splits[i // 2 - 1],) if i else found.low
            high = (splits[i // 2],) if i // 2 < len(splits) else found.high
            bounds = (found.prefix, low, high)
        found = SortedRange(*bounds, before, counts[i], total)
    return found


def _split_values(part: DataFrame, key: SortKey) -> list:
    """A few values of one key, in its order, that cut the rows about evenly.

    Numbers and dates have a quantile sketch. Strings are sketched by the four characters after
    what all of them begin with; a split is the least string at or after each quantile.
    """
    kind = part.select(key.column.alias("k")).schema["k"].dataType.typeName()
    if kind == "boolean":
        return _in_order([None, False, True], key.descending)
    shares = [(i + 0.5) / _SPLITS for i in range(_SPLITS)]
    if kind in ("byte", "short", "integer", "long", "float", "double", "timestamp_ntz", "timestamp", "date"):
        row = part.agg(F.percentile_approx(key.column, shares, 1000).alias("q"), F.count_if(key.column.isNull()).alias("nulls")).first()
        found = list(row["q"] or [])
    else:
        low, high = part.agg(F.min(key.column), F.max(key.column)).first()
        same = len(os.path.commonprefix([low or "", high or ""]))
        codes = [F.coalesce(F.ascii(F.substring(key.column, same + i, 1)), F.lit(0)).cast("long") for i in range(1, 5)]
        place = codes[0]
        for c in codes[1:]:
            place = F.shiftleft(place, 15).bitwiseOR(F.least(c, F.lit(0x7FFF)))
        ranked = part.select(key.column.alias("k"), F.when(key.column.isNotNull(), place).alias("p"))
        row = ranked.agg(F.percentile_approx("p", shares, 1000).alias("q"), F.count_if(F.col("k").isNull()).alias("nulls")).first()
        ends = list(dict.fromkeys(row["q"] or []))
        least = ranked.agg(*[F.min(F.when(F.col("p") >= q, F.col("k"))).alias(f"k{i}") for i, q in enumerate(ends)]).first() if ends else []
        found = [v for v in least if v is not None]
    if row["nulls"]:
        found.append(None)
    return _in_order(list(dict.fromkeys(found)), key.descending)


def _in_order(values: list, descending: bool) -> list:
    """Distinct values in the order of a key: NULL first ascending, last descending."""
    held = sorted((v for v in values if v is not None), reverse=descending)
    none = [None] * (len(held) < len(values))
    return [*held, *none] if descending else [*none, *held]


def _same_row(keys: Sequence[SortKey], values: Sequence) -> Column:
    same = F.lit(True)
    for key, value in zip(keys, values):
        same = same & key.same(value)
    return same


def before_row(keys: Sequence[SortKey], values: Sequence) -> Column:
    """Rows strictly before the row with these key values, key by key."""
    condition = F.lit(False)
    for key, value in reversed(list(zip(keys, values, strict=True))):
        condition = key.before(value) | (key.same(value) & condition)
    return condition


def page_after(df: DataFrame, keys: Sequence[SortKey], last: Sequence, size: int) -> DataFrame:
    """The ``size`` rows after the last row seen, given that row's key values."""
    return page_rows(df.where(after_row(keys, last)), keys, 1, size)


def top(df: DataFrame, keys: Sequence[SortKey], k: int) -> DataFrame:
    return page_rows(df, keys, 1, k)


def total_hits(df: DataFrame) -> Column:
    """Number of rows of ``df``, as a column for another query."""
    return df.agg(F.count(F.lit(1)).alias("total")).scalar()
