"""Projections and filters on typed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnseek.functions.dates import format_date, from_nanos, to_nanos
from tarnseek.functions.jsonvals import decode_object, member, member_or_null_text, value_kind
from tarnseek.operators.clauses import Between, Compare, Equals, HasField, Like, matching
from tarnseek.operators.view import TableView
from tarnseek.plans.registered.registry import query
from tarnseek.plans.registered.tables import labelled, table, view
from tarnseek.schema import Field, Kind, TableSpec
from tarnseek.sources.records import to_records


def _filter(name: str, table_name: str, where, columns: list[str], sql_where: str) -> None:
    """Register ``SELECT columns FROM table WHERE …`` as a clause and as SQL."""

    @query(name, f"SELECT {', '.join(columns)} FROM {table_name} WHERE {sql_where}")
    def run(spark, sf_dir):
        return matching(view(spark, sf_dir, table_name), where).df.select(*columns)


_ORDER = ["o_orderkey", "o_orderdate", "o_totalprice"]
_PART = ["p_partkey", "p_name", "p_type", "p_size"]
_EVENT = ["event_id", "ts", "user_id", "event_type", "value"]

_filter("project_cols", "lineitem", None, ["l_orderkey", "l_linenumber", "l_shipdate"], "true")
_filter(
    "filter_none",
    "orders",
    None,
    ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "true",
)
_filter("filter_eq_int", "part", Equals("p_size", 11), _PART, "p_size = 11")
_filter("filter_eq_long", "events", Equals("user_id", 42), _EVENT, "user_id = 42")
_filter(
    "filter_eq_date",
    "orders",
    Equals("o_orderdate", "1998-10-03"),
    _ORDER,
    "o_orderdate = TIMESTAMP '1998-10-03'",
)
_filter(
    "filter_eq_string",
    "customer",
    Equals("c_mktsegment", "BUILDING"),
    ["c_custkey", "c_name", "c_mktsegment"],
    "c_mktsegment = 'BUILDING'",
)
_filter("filter_range_int", "part", Compare("p_size", ">", 40), _PART, "p_size > 40")
_filter(
    "filter_range_long",
    "documents",
    Compare("n_chars", "<=", 1000),
    ["doc_id", "n_chars"],
    "n_chars <= 1000",
)
_filter(
    "filter_range_date",
    "events",
    Compare("ts", ">=", "2024-01-15T12:00:00.012000"),
    _EVENT,
    "ts >= TIMESTAMP '2024-01-15 12:00:00.012'",
)
_filter(
    "filter_range_double",
    "lineitem",
    Compare("l_quantity", "<", 5.3),
    ["l_orderkey", "l_linenumber", "l_quantity"],
    "l_quantity < 5.3",
)
_filter("filter_range_double_on_int", "part", Compare("p_size", ">=", 40.5), _PART, "p_size >= 40.5")
_filter("filter_between_int", "part", Between("p_size", 10, 14), _PART, "p_size BETWEEN 10 AND 14")
_filter(
    "filter_between_double",
    "lineitem",
    Between("l_discount", 0.03, 0.05),
    ["l_orderkey", "l_linenumber", "l_discount"],
    "l_discount BETWEEN 0.03::DOUBLE AND 0.05::DOUBLE",
)
_filter(
    "filter_between_date",
    "orders",
    Between("o_orderdate", "1996-01-01", "1996-03-31"),
    _ORDER,
    "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31'",
)
_filter("filter_has_field", "customer", HasField("c_mktsegment"), ["c_custkey"], "c_mktsegment IS NOT NULL")
_filter("like_prefix", "part", Like("p_name", "red*"), _PART, "starts_with(p_name, 'red')")
_filter("like_suffix", "part", Like("p_name", "*ring"), _PART, "suffix(p_name, 'ring')")
_filter(
    "like_glob_string",
    "pages",
    Like("url", "http*example.com/*page=?&*"),
    ["page_id", "url"],
    r"regexp_matches(url, '^http.*example\.com/.*page=.&.*$')",
)
_filter(
    "like_glob_single_char",
    "part",
    Like("p_name", "?o?? *"),
    _PART,
    "regexp_matches(p_name, '^.o.. .*$')",
)
_filter(
    "like_sql_wildcards_are_plain",
    "pages",
    Like("html", "*%%%*"),
    ["page_id"],
    "contains(html, '%%%')",
)
_filter(
    "filter_and",
    "part",
    Equals("p_type", "PROMO") & Compare("p_size", "<", 20),
    _PART,
    "p_type = 'PROMO' AND p_size < 20",
)
_filter(
    "filter_or",
    "part",
    Equals("p_type", "SMALL") | Compare("p_size", ">", 45),
    _PART,
    "p_type = 'SMALL' OR p_size > 45",
)
_filter(
    "filter_nested",
    "part",
    (Equals("p_type", "PROMO") & Like("p_name", "r?d*"))
    | (Compare("p_size", ">", 45) | Between("p_partkey", 1, 40))
    & Compare("p_retailprice", "<=", 1005.3),
    _PART,
    "(p_type = 'PROMO' AND regexp_matches(p_name, '^r.d.*$')) "
    "OR ((p_size > 45 OR p_partkey BETWEEN 1 AND 40) AND p_retailprice <= 1005.3)",
)


@query(
    "project_dynamic_json",
    "SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events",
)
def project_dynamic_json(spark, sf_dir):
    members = decode_object(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", member(members, "k").alias("k"))


@query(
    "project_missing_default",
    "SELECT CAST(d.doc_id AS VARCHAR) AS _key, coalesce(CAST(l.quality AS VARCHAR), 'null') AS quality, "
    "'null' AS nowhere FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def project_missing_default(spark, sf_dir):
    rows = labelled(spark, sf_dir).df
    records = to_records(rows, F.lit("labelled"), F.col("doc_id"), "doc_id", "quality", "toxic")
    members = decode_object(F.col("value"))
    return records.select(
        "_key",
        member_or_null_text(members, "quality").alias("quality"),
        member_or_null_text(members, "nowhere").alias("nowhere"),
    )


@query("ts_to_nanos", "SELECT event_id, epoch_us(ts) * 1000 AS nanos FROM events")
def ts_to_nanos(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", to_nanos(F.col("ts")).alias("nanos"))


@query("nanos_to_ts", "SELECT o_orderkey, o_orderdate AS back FROM orders")
def nanos_to_ts(spark, sf_dir):
    nanos = to_nanos(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", from_nanos(nanos).alias("back"))


@query(
    "date_format_out",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS shown FROM events",
)
def date_format_out(spark, sf_dir):
    shown = format_date(F.col("ts"), "uuuu-MM-dd'T'HH:mm:ss.SSSSSS")
    return table(spark, sf_dir, "events").select("event_id", shown.alias("shown"))


@query(
    "json_number_types",
    """
    SELECT event_id, 'int' AS k, CASE WHEN user_id * 100000000 <= 2147483647 THEN 'int' ELSE 'long' END AS big,
           'double' AS value, 'string' AS event_type, 'object' AS inner_value, CAST(NULL AS VARCHAR) AS nowhere
    FROM events
    """,
)
def json_number_types(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    made = F.to_json(
        F.struct(
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            (F.col("user_id") * 100_000_000).alias("big"),
            "value",
            "event_type",
            F.struct("user_id").alias("inner"),
        )
    )
    kinds = {"k": "k", "big": "big", "value": "value", "event_type": "event_type", "inner": "inner_value",
             "nowhere": "nowhere"}
    return events.select("event_id", made.alias("made")).select(
        "event_id", *[value_kind(F.col("made"), f"$.{m}").alias(alias) for m, alias in kinds.items()]
    )


@query(
    "filter_has_label",
    "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL",
)
def filter_has_label(spark, sf_dir):
    """A field that most rows lack."""
    return matching(labelled(spark, sf_dir), HasField("quality")).df.select("doc_id", "quality")


@query(
    "filter_date_day_first",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-10-03' AND o_orderdate < TIMESTAMP '1999-02-01'",
)
def filter_date_day_first(spark, sf_dir):
    """Dates given as d/M/yyyy, by the pattern of the column."""
    spec = TableSpec("orders", (Field("o_orderkey", Kind.LONG), Field("o_orderdate", Kind.DATE, "d/M/yyyy")))
    orders = TableView(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), spec, ("o_orderkey",))
    where = Compare("o_orderdate", ">=", "3/10/1998") & Compare("o_orderdate", "<", "1/2/1999")
    return matching(orders, where).df.select("o_orderkey", "o_orderdate")
