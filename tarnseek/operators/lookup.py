"""Key lookup: fetch the current records of a page of hits."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tarnseek.functions.columns import fresh_names


def fetch_records(hits: DataFrame, records: DataFrame, on: Sequence[str]) -> DataFrame:
    """Hits joined to their records; a hit whose record is gone is left out.

    How they are joined is left to the planner, which knows how many bytes the
    hits have; a page of wide rows may be many.
    """
    return records.join(hits, list(on), "inner")


def latest_records(records: DataFrame, on: Sequence[str], version: str) -> DataFrame:
    """The newest version of each record of a log that keeps old ones: one row per key.

    Keys with null parts are keys like any other, and a null version is older than all others. Of rows that share key and
    newest version, as in a log that was replayed, the least by all columns that have an order stays. Each task keeps one
    row per key before the shuffle.
    """
    ties = [F.col(f"`{f.name}`") for f in records.schema.fields if not re.search(r"\b(map<|variant\b)", f.dataType.simpleString())]
    newest = Window.partitionBy(*on).orderBy(F.col(version).desc_nulls_last(), *ties)
    [place] = fresh_names(records, "_place")
    return records.withColumn(place, F.row_number().over(newest)).where(F.col(place) == 1).drop(place)
