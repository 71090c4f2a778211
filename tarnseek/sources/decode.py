"""Records → typed rows: lenient JSON, typed fields, token arrays, quarantine.

The record's text is kept as ``_value``. Everything is one projection, so ingest needs no shuffle and reads each record
once. A row that can't be used is kept with the reason in ``_error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tarnseek.errors import TarnseekError
from tarnseek.functions.columns import pin
from tarnseek.functions.dates import parse_date
from tarnseek.functions.jsonvals import decode_object, member
from tarnseek.schema import Field, Kind, TableSpec

OK, BAD = "ok", "bad"
BAD_VALUE_CHOICES = ("quarantine", "null", "fail")


def typed(text: Column, field: Field) -> Column:
    """A member's text as the field's type; NULL if it isn't one. Quoted numbers are fine."""
    if field.kind in (Kind.STRING, Kind.TEXT):
        return text
    if field.kind is Kind.DATE and field.pattern is not None:
        return parse_date(text, field.pattern)
    return text.try_cast(field.spark_type)


def decode_records(records: DataFrame, spec: TableSpec, on_bad_value: str = "quarantine") -> DataFrame:
    """Typed rows of ``records`` with ``_error`` and ``_status`` ("ok" or "bad").

    A record that isn't a JSON object, or has no name or key, is bad. A field
    whose value doesn't fit its type makes the record bad ("quarantine"), reads
    as missing ("null") or ends the job ("fail").
    """
    if on_bad_value not in BAD_VALUE_CHOICES:
        raise TarnseekError(f"on_bad_value is one of {', '.join(BAD_VALUE_CHOICES)}")
    parsed = pin(records.select("_name", "_key", "value"), decode_object(F.col("value")), "_members")
    members = F.col("_members")
    columns, misfits = [], []
    for field in spec.fields:
        text = member(members, field.name)
        value = typed(text, field)
        columns.append(value.alias(field.name))
        if field.kind is Kind.TEXT:
            columns.append(spec.analyzer.slots(text).alias(field.token_column))
        elif field.kind is not Kind.STRING:
            reason = F.concat(F.lit(f"{field.name}: not a {field.kind.value}: "), text)
            misfits.append(F.when(text.isNotNull() & value.isNull(), reason))
    reasons = [
        F.when(F.col("_name").isNull() | F.col("_key").isNull(), F.lit("no name or key")),
        F.when(members.isNull(), F.lit("not a JSON object")),
    ]
    if on_bad_value == "quarantine":
        reasons += misfits
    elif on_bad_value == "fail":
        reasons += [F.when(m.isNotNull(), F.raise_error(m).cast("string")) for m in misfits]
    error = F.coalesce(*reasons)
    raw = F.col("value").alias("_value")
    rows = parsed.select("_name", "_key", raw, error.alias("_error"), *columns)
    return rows.withColumn("_status", F.when(F.col("_error").isNull(), OK).otherwise(BAD))


def usable(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("_error").isNull()).drop("_error", "_status")


def quarantined(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("_error").isNotNull()).select("_name", "_key", "_value", "_error")
