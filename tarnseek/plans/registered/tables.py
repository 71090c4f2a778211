"""The given tables as typed views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnseek.operators.view import TableView
from tarnseek.schema import Field, Kind, TableSpec
from tarnseek.sources.records import to_records

MICROS = "uuuu-MM-dd'T'HH:mm:ss.SSSSSS"
DAY = "yyyy-MM-dd"

SPECS = {
    "documents": (
        [
            Field("doc_id", Kind.LONG),
            Field("text", Kind.TEXT),
            Field("lang", Kind.STRING),
            Field("source", Kind.STRING),
            Field("n_chars", Kind.LONG),
        ],
        ("doc_id",),
    ),
    "events": (
        [
            Field("event_id", Kind.LONG),
            Field("ts", Kind.DATE, MICROS),
            Field("user_id", Kind.LONG),
            Field("event_type", Kind.STRING),
            Field("value", Kind.DOUBLE),
            Field("props", Kind.STRING),
        ],
        ("event_id",),
    ),
    "orders": (
        [
            Field("o_orderkey", Kind.LONG),
            Field("o_custkey", Kind.LONG),
            Field("o_orderstatus", Kind.STRING),
            Field("o_totalprice", Kind.DOUBLE),
            Field("o_orderdate", Kind.DATE, DAY),
            Field("o_orderpriority", Kind.STRING),
        ],
        ("o_orderkey",),
    ),
    "lineitem": (
        [
            Field("l_orderkey", Kind.LONG),
            Field("l_partkey", Kind.LONG),
            Field("l_suppkey", Kind.LONG),
            Field("l_linenumber", Kind.INT),
            Field("l_quantity", Kind.DOUBLE),
            Field("l_extendedprice", Kind.DOUBLE),
            Field("l_discount", Kind.DOUBLE),
            Field("l_tax", Kind.DOUBLE),
            Field("l_returnflag", Kind.STRING),
            Field("l_linestatus", Kind.STRING),
            Field("l_shipdate", Kind.DATE, DAY),
        ],
        ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"),
    ),
    "part": (
        [
            Field("p_partkey", Kind.LONG),
            Field("p_name", Kind.STRING),
            Field("p_brand", Kind.STRING),
            Field("p_type", Kind.STRING),
            Field("p_size", Kind.INT),
            Field("p_retailprice", Kind.DOUBLE),
        ],
        ("p_partkey",),
    ),
    "customer": (
        [
            Field("c_custkey", Kind.LONG),
            Field("c_name", Kind.STRING),
            Field("c_nationkey", Kind.INT),
            Field("c_acctbal", Kind.DOUBLE),
            Field("c_mktsegment", Kind.STRING),
        ],
        ("c_custkey",),
    ),
    "pages": (
        [Field("page_id", Kind.LONG), Field("url", Kind.STRING), Field("html", Kind.STRING)],
        ("page_id",),
    ),
    "conversations": (
        [
            Field("conv_id", Kind.LONG),
            Field("turn", Kind.LONG),
            Field("role", Kind.STRING),
            Field("text", Kind.TEXT),
        ],
        ("conv_id", "turn"),
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> TableView:
    fields, tie = SPECS[name]
    return TableView(table(spark, sf_dir, name), TableSpec(name, tuple(fields)), tie)


def labelled(spark: SparkSession, sf_dir: str) -> TableView:
    """Documents with their labels, missing for most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    df = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    fields = (
        Field("doc_id", Kind.LONG),
        Field("lang", Kind.STRING),
        Field("source", Kind.STRING),
        Field("n_chars", Kind.LONG),
        Field("quality", Kind.INT),
        Field("toxic", Kind.INT),
    )
    return TableView(df, TableSpec("labelled", fields), ("doc_id",))


def event_records(
    spark: SparkSession, sf_dir: str, *columns: str, where: Column | None = None
) -> DataFrame:
    """Events as keyed JSON records, one list per event type."""
    columns = columns or ("event_id", "ts", "user_id", "event_type", "value", "props")
    name = F.concat(F.lit("list_"), F.col("event_type"))
    events = table(spark, sf_dir, "events")
    events = events if where is None else events.where(where)
    return to_records(events, name, F.col("event_id"), *columns)


EVENT_SPEC = TableSpec("events", tuple(SPECS["events"][0]))
