"""A DataFrame read through a table spec."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from tarnseek.errors import TarnseekError
from tarnseek.functions import columns
from tarnseek.schema import Field, Kind, TableSpec


#: A setting of the session: texts are dealt over so many tasks before they are tokenised. Unset, they stay as the scan
#: splits them, which suits tables of many row groups; a table of one row group would be tokenised by one task.
TEXT_SPLITS = "spark.tarnseek.textSplits"


@dataclass(frozen=True)
class TableView:
    """``tie`` names columns that identify a row, in insertion order where known.

    They end every sort, so pages never overlap.
    """

    df: DataFrame
    spec: TableSpec
    tie: tuple[str, ...]
    # Text measures the rows carry from an index: what is measured → column name.
    measured: Mapping[tuple, str] | None = None

    def text_field(self, name: str) -> Field:
        field = self.spec.field(name)
        if field.kind is not Kind.TEXT:
            raise TarnseekError(f"column[{name}] is not a text column")
        return field

    def has_token_column(self, field: Field) -> bool:
        return field.token_column in self.df.columns

    def token_slots(self, name: str) -> Column:
        """The token array of a TEXT field, stored or added by ``with_tokens``."""
        field = self.text_field(name)
        if not self.has_token_column(field):
            raise TarnseekError(f"the tokens of column[{name}] haven't been worked out")
        return F.col(field.token_column)

    def measure(self, *what: str) -> Column | None:
        """A measure taken from an index: a count (0 if absent), or None without an index."""
        if self.measured is None:
            return None
        return F.coalesce(F.col(self.measured[what]), F.lit(0))

    def with_tokens(self, *names: str) -> TableView:
        """The view with token columns for these TEXT fields, each worked out once per row."""
        df = self.df
        missing = [f for f in map(self.text_field, dict.fromkeys(names)) if f.token_column not in df.columns]
        splits = df.sparkSession.conf.get(TEXT_SPLITS, None)
        if missing and splits:
            df = df.repartition(int(splits))
        for field in missing:
            df = columns.pin(df, self.spec.analyzer.slots(F.col(field.name)), field.token_column)
        return replace(self, df=df)

    def where(self, condition: Column) -> TableView:
        return replace(self, df=self.df.where(condition))
