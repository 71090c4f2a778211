"""Small helpers on Columns and DataFrames used across the package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Inside ``body`` the value is a lambda variable, so it may be used many
    times, also in nested lambdas, without being worked out again.
    """
    return F.transform(F.array(value), body)[0]


def pin(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add ``value`` as a column that later filters don't recompute.

    The optimizer moves a filter below a projection by copying the projected
    expression into it. It cannot do so below an ``explode``, so an expensive
    expression (tokenising a text) is worked out once per row.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes not to be one of ``df``'s, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
