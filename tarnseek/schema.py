"""Table specs: typed fields, a record source and a text analyzer.

A spec is plain data. It is stored as JSON beside a table and turned into a
Spark ``StructType`` whenever the table is read or written.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field as dc_field
from enum import Enum

from pyspark.sql import types as T

from tarnseek.errors import TarnseekError
from tarnseek.functions.analyzers import Analyzer, Tokenizing, analyzer_named

KEY_COLUMNS = ("_name", "_key")
# What tells a stored row from all others, in order of arrival.
ROW_ID = ("_batch_id", "_row")
TOKEN_SUFFIX = "__tokens"


class Kind(str, Enum):
    INT = "int"
    LONG = "long"
    DOUBLE = "double"
    DATE = "date"
    STRING = "string"
    TEXT = "text"

    @staticmethod
    def of(name: str | Kind) -> Kind:
        try:
            return Kind(name.lower())
        except ValueError:
            raise TarnseekError(f"unknown field type [{name}]") from None

    @property
    def is_number(self) -> bool:
        return self in (Kind.INT, Kind.LONG, Kind.DOUBLE)

    @property
    def is_sortable(self) -> bool:
        """TEXT is split into tokens, so it can be neither sorted nor grouped."""
        return self is not Kind.TEXT


_SPARK_TYPES = {
    Kind.INT: T.IntegerType(),
    Kind.LONG: T.LongType(),
    Kind.DOUBLE: T.DoubleType(),
    Kind.DATE: T.TimestampNTZType(),
    Kind.STRING: T.StringType(),
    Kind.TEXT: T.StringType(),
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: Kind
    pattern: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "kind", Kind.of(self.kind))
        if not self.name:
            raise TarnseekError("a field needs a name")
        if self.name.startswith("_"):
            raise TarnseekError(f"field [{self.name}]: names starting with '_' are internal")
        if self.name.endswith(TOKEN_SUFFIX):
            raise TarnseekError(f"field [{self.name}]: names ending in '{TOKEN_SUFFIX}' are internal")

    @property
    def spark_type(self) -> T.DataType:
        return _SPARK_TYPES[self.kind]

    @property
    def token_column(self) -> str:
        return self.name + TOKEN_SUFFIX

    def struct_field(self) -> T.StructField:
        meta = {"kind": self.kind.value}
        if self.pattern:
            meta["format"] = self.pattern
        return T.StructField(self.name, self.spark_type, True, meta)


@dataclass(frozen=True)
class RecordSource:
    """Where a table's records come from: an append-only LIST log or a keyed HASH.

    ``by_name`` says that each name has its folder ``_name=…``, as ``partitionBy("_name")`` writes them.
    """

    kind: str
    path: str
    name: str
    format: str = "parquet"
    by_name: bool = False

    def __post_init__(self):
        if self.kind.lower() not in ("list", "hash"):
            raise TarnseekError(f"unknown source type [{self.kind}]")
        object.__setattr__(self, "kind", self.kind.lower())
        if self.kind == "hash" and self.format != "parquet":
            raise TarnseekError("hashes are read from parquet files")
        for part in ("path", "name"):
            if not getattr(self, part):
                raise TarnseekError(f"the source has no [{part}]")


@dataclass(frozen=True)
class TableSpec:
    name: str
    fields: tuple[Field, ...]
    source: RecordSource | None = None
    analyzer: Tokenizing = dc_field(default_factory=lambda: analyzer_named("standard"))

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))
        if not self.name or any(c in self.name for c in "/\\* ") or self.name.startswith(("_", ".")):
            raise TarnseekError(f"bad table name [{self.name}]")
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise TarnseekError(f"table [{self.name}] declares a field twice")

    @property
    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise TarnseekError(f"column name[{name}] is not defined")

    def has(self, name: str) -> bool:
        return name in self.field_names

    def declared_struct(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])

    def stored_struct(self) -> T.StructType:
        """Columns of the parquet files of a table (partition columns last)."""
        cols = [
            T.StructField("_name", T.StringType()),
            T.StructField("_key", T.StringType()),
            T.StructField("_value", T.StringType()),
            T.StructField("_error", T.StringType()),
            T.StructField("_row", T.LongType()),
        ]
        for f in self.fields:
            cols.append(f.struct_field())
            if f.kind is Kind.TEXT:
                cols.append(T.StructField(f.token_column, T.ArrayType(T.StringType())))
        cols.append(T.StructField("_batch_id", T.LongType()))
        cols.append(T.StructField("_status", T.StringType()))
        return T.StructType(cols)

    def to_json(self) -> str:
        return json.dumps(
            {
                "name": self.name,
                "fields": [
                    {"name": f.name, "kind": f.kind.value, "pattern": f.pattern} for f in self.fields
                ],
                "source": None if self.source is None else vars(self.source),
                "analyzer": self.analyzer.to_dict(),
            },
            ensure_ascii=False,
        )

    @staticmethod
    def from_json(text: str) -> TableSpec:
        raw = json.loads(text)
        return TableSpec(
            name=raw["name"],
            fields=tuple(Field(f["name"], f["kind"], f["pattern"]) for f in raw["fields"]),
            source=RecordSource(**raw["source"]) if raw["source"] else None,
            analyzer=Analyzer.from_dict(raw["analyzer"]),
        )
