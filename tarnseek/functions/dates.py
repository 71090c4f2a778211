"""Dates: text by pattern ↔ TIMESTAMP_NTZ ↔ nanoseconds since 1970 (UTC)."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.errors import SparkUpgradeException
from pyspark.sql import Column, SparkSession, functions as F

from tarnseek.errors import TarnseekError

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def spark_pattern(pattern: str) -> str:
    """Spark writes the year ``yyyy``; ``uuuu`` outside quotes means the same here."""
    pieces = re.split(r"('[^']*')", pattern)
    return "".join(p if p.startswith("'") else p.replace("u", "y") for p in pieces)


def micros_to_ntz(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH))


def ntz_to_micros(ts: Column) -> Column:
    """Microseconds since 1970, from the parts of an interval: no time zone is involved."""
    since = ts - F.expr(_EPOCH)

    def part(unit: str) -> Column:
        return F.date_part(F.lit(unit), since)

    whole = part("DAY").cast("long") * 86_400 + part("HOUR") * 3_600 + part("MINUTE") * 60
    return whole * 1_000_000 + (part("SECOND") * 1_000_000).cast("long")


def parse_date(text: Column, pattern: str) -> Column:
    """Text → TIMESTAMP_NTZ; NULL if it doesn't fit the pattern.

    The text is read as UTC, so the session time zone and its clock changes
    never move a value.
    """
    instant = F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(spark_pattern(pattern) + "XXX"))
    return micros_to_ntz(F.unix_micros(instant))


def to_nanos(ts: Column) -> Column:
    return ntz_to_micros(ts) * F.lit(1000).cast("long")


def from_nanos(nanos: Column) -> Column:
    whole = nanos - F.pmod(nanos, F.lit(1000))
    return micros_to_ntz(F.call_function("div", whole, F.lit(1000)))


def format_date(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, spark_pattern(pattern))


# --- literals in predicates ---------------------------------------------------
def date_literal(value: object, pattern: str | None) -> datetime:
    """A predicate's date: text in the field's pattern, encoded nanos, or a datetime.

    Text is read by the same expression as the column, so it fits whatever ingest accepts.
    """
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    if isinstance(value, int) and not isinstance(value, bool):
        return datetime(1970, 1, 1) + timedelta(microseconds=value // 1000)
    if not isinstance(value, str):
        raise TarnseekError(f"[{value!r}] is not a date")
    if pattern is None:
        try:
            return datetime.fromisoformat(value)
        except ValueError:
            raise TarnseekError(f"[{value}] is not an ISO date") from None
    # One row that the optimizer works out itself: no job runs.
    one = SparkSession.active().sql("SELECT 1")
    try:
        found = one.select(parse_date(F.lit(value), pattern)).first()[0]
    except SparkUpgradeException:
        found = None
    if found is None:
        raise TarnseekError(f"[{value}] does not fit the date pattern [{pattern}]")
    return found
