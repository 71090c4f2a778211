"""Record sources, JSON decode and key lookup, in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnseek.functions.jsonvals import result_json
from tarnseek.operators.clauses import Compare, matching
from tarnseek.operators.lookup import fetch_records, latest_records
from tarnseek.operators.ordering import page_rows, sort_keys
from tarnseek.plans.registered.registry import query
from tarnseek.plans.registered.tables import EVENT_SPEC, MICROS, event_records, table, view
from tarnseek.schema import Field, Kind, TableSpec
from tarnseek.sources.decode import decode_records, usable
from tarnseek.sources.records import hash_range, list_range, name_matches, to_records


@query(
    "ingest_list",
    "SELECT 'list_' || event_type AS _name, CAST(event_id AS VARCHAR) AS _key, "
    "event_id, ts, user_id, event_type, value, props FROM events",
)
def ingest_list(spark, sf_dir):
    rows = usable(decode_records(event_records(spark, sf_dir), EVENT_SPEC))
    return rows.select("_name", "_key", *EVENT_SPEC.field_names)


@query(
    "ingest_list_range",
    "SELECT 'log' AS _name, CAST(event_id AS VARCHAR) AS _key, user_id FROM events "
    "WHERE event_id BETWEEN 500 AND 999",
)
def ingest_list_range(spark, sf_dir):
    """The second batch of 500 elements of a list."""
    log = to_records(table(spark, sf_dir, "events"), F.lit("log"), F.col("event_id"), "user_id")
    rows = usable(decode_records(list_range(log, "log", 500, 500), EVENT_SPEC))
    return rows.select("_name", "_key", "user_id")


@query(
    "ingest_hash_range",
    """
    SELECT 'hash_' || event_type AS _name, lpad(CAST(event_id AS VARCHAR), 12, '0') AS _key, user_id
    FROM events WHERE event_type = 'click' AND lpad(CAST(event_id AS VARCHAR), 12, '0') > '000000000300'
    ORDER BY _key LIMIT 500
    """,
)
def ingest_hash_range(spark, sf_dir):
    """The next 500 pairs of a hash after a key."""
    name = F.concat(F.lit("hash_"), F.col("event_type"))
    key = F.lpad(F.col("event_id").cast("string"), 12, "0")
    pairs = to_records(table(spark, sf_dir, "events"), name, key, "user_id")
    rows = usable(decode_records(hash_range(pairs, "hash_click", "000000000300", 500), EVENT_SPEC))
    return rows.select("_name", "_key", "user_id")


@query(
    "ingest_prefix",
    "SELECT 'list_' || event_type AS _name, CAST(event_id AS VARCHAR) AS _key, event_id "
    "FROM events WHERE event_type LIKE 'p%'",
)
def ingest_prefix(spark, sf_dir):
    chosen = event_records(spark, sf_dir, "event_id").where(name_matches("list_p*"))
    return usable(decode_records(chosen, EVENT_SPEC)).select("_name", "_key", "event_id")


def _damaged(spark, sf_dir):
    """Event records some of which are cut short, not objects, empty or wrongly typed."""
    good = event_records(spark, sf_dir, "event_id", "user_id", "event_type")
    key = F.col("_key").cast("long")
    value = (
        F.when(key % 100 == 0, F.substring("value", 1, 9))
        .when(key % 100 == 1, F.lit("[1, 2]"))
        .when(key % 100 == 2, F.lit(""))
        .when(key % 100 == 3, F.regexp_replace("value", '"user_id":[0-9]+', '"user_id":"x"'))
        .when(key % 100 == 4, F.regexp_replace("value", '"user_id":([0-9]+)', "'user_id':'$1'"))
        .otherwise(F.col("value"))
    )
    return good.withColumn("value", value)


@query(
    "ingest_bad_records",
    """
    SELECT CAST(event_id AS VARCHAR) AS _key,
           CASE WHEN event_id % 100 IN (0, 1, 2) THEN 'not a JSON object'
                WHEN event_id % 100 = 3 THEN 'user_id: not a long: x' END AS _error,
           CASE WHEN event_id % 100 IN (0, 1, 2, 3) THEN NULL ELSE user_id END AS user_id
    FROM events
    """,
)
def ingest_bad_records(spark, sf_dir):
    return decode_records(_damaged(spark, sf_dir), EVENT_SPEC).select("_key", "_error", "user_id")


@query(
    "ingest_bad_value_as_missing",
    "SELECT CAST(event_id AS VARCHAR) AS _key, CASE WHEN event_id % 100 = 3 THEN NULL ELSE user_id END AS user_id "
    "FROM events WHERE event_id % 100 NOT IN (0, 1, 2)",
)
def ingest_bad_value_as_missing(spark, sf_dir):
    rows = usable(decode_records(_damaged(spark, sf_dir), EVENT_SPEC, on_bad_value="null"))
    return rows.select("_key", "user_id")


@query(
    "ingest_typed",
    "SELECT CAST(event_id AS VARCHAR) AS _key, CAST(user_id AS INTEGER) AS small, user_id AS big, value, event_type, "
    "CAST(NULL AS BIGINT) AS absent FROM events",
)
def ingest_typed(spark, sf_dir):
    """Numbers given as JSON numbers or as quoted digits; one declared field never given."""
    quoted = F.col("user_id").cast("string").alias("big")
    made = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("small"), quoted, "value", "event_type"
    )
    spec = TableSpec(
        "typed",
        (
            Field("small", Kind.INT),
            Field("big", Kind.LONG),
            Field("value", Kind.DOUBLE),
            Field("event_type", Kind.STRING),
            Field("absent", Kind.LONG),
        ),
    )
    records = to_records(made, F.lit("typed"), F.col("event_id"), "small", "big", "value", "event_type")
    return usable(decode_records(records, spec)).select("_key", *spec.field_names)


@query(
    "ingest_date_pattern",
    "SELECT CAST(event_id AS VARCHAR) AS _key, ts AS seen, date_trunc('day', ts) AS day FROM events",
)
def ingest_date_pattern(spark, sf_dir):
    made = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("seen"),
        F.concat(F.date_format("ts", "dd/MM/yyyy"), F.lit(" 00:00")).alias("day"),
    )
    spec = TableSpec(
        "dates", (Field("seen", Kind.DATE, MICROS), Field("day", Kind.DATE, "dd/MM/uuuu HH:mm"))
    )
    records = to_records(made, F.lit("dates"), F.col("event_id"), "seen", "day")
    return usable(decode_records(records, spec)).select("_key", "seen", "day")


@query(
    "lookup_fetch",
    """
    SELECT 'list_' || event_type AS _name, CAST(event_id AS VARCHAR) AS _key, value AS score, user_id FROM (
        SELECT * FROM events WHERE value > 20 ORDER BY value DESC, event_id LIMIT 200
    ) WHERE event_type <> 'error'
    """,
)
def lookup_fetch(spark, sf_dir):
    """A page of hits joined to their records; the records of one list are gone."""
    events = view(spark, sf_dir, "events")
    hits = matching(events, Compare("value", ">", 20))
    page = page_rows(hits.df, sort_keys(hits, ["value desc"]), 1, 200).select(
        F.concat(F.lit("list_"), F.col("event_type")).alias("_name"),
        F.col("event_id").cast("string").alias("_key"),
        F.col("value").alias("score"),
    )
    records = event_records(spark, sf_dir, "user_id").where(F.col("_name") != "list_error")
    found = fetch_records(page, records, ["_name", "_key"])
    return found.select("_name", "_key", "score", F.get_json_object("value", "$.user_id").cast("long").alias("user_id"))


@query(
    "lookup_latest",
    """
    SELECT user_id, event_id, event_type FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events
    ) WHERE r = 1
    """,
)
def lookup_latest(spark, sf_dir):
    """The current record of each key of a log that keeps old ones."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return latest_records(events, ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query(
    "result_json",
    """
    SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id
           || ',"nothing":null}' AS json FROM events
    """,
)
def result_as_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("nothing", F.lit(None).cast("string"))
    return rows.select("event_id", result_json(["event_id", "event_type", "user_id", "nothing"]).alias("json"))
