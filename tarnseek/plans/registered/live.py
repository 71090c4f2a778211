"""Streaming tables: ingest, resume, live reads and snapshots.

Each query feeds a whole table through a stream into a new work folder, in one
or several arrivals, and returns what the streamed table then answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tarnseek.operators.clauses import Compare, Equals, Like, MatchAny
from tarnseek.plans.catalog import Catalog
from tarnseek.plans.registered.registry import query
from tarnseek.plans.registered.tables import SPECS, event_records, table
from tarnseek.plans.registered.text import BM25_CTE
from tarnseek.plans.search import page_with_total
from tarnseek.schema import RecordSource
from tarnseek.sources.records import to_records
from tarnseek.sources.storage import work_folder

# Events arrive in three lots, by day of the month.
_LOTS = (0, 10, 20, 31)
_TOKEN_LIFETIME = 3600


class _Feed:
    """A catalog with one table ``events`` fed by lots of events."""

    def __init__(self, spark: SparkSession, sf_dir: str, purpose: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.folder = work_folder(spark, purpose)
        self.catalog = Catalog(spark, f"{self.folder}/tables", search_expired=_TOKEN_LIFETIME)

    def arrive(self, lot: int, by_name: bool = False) -> None:
        day = F.dayofmonth("ts")
        in_lot = (day > _LOTS[lot]) & (day <= _LOTS[lot + 1])
        writer = event_records(self.spark, self.sf_dir, where=in_lot).write.mode("append")
        (writer.partitionBy("_name") if by_name else writer).parquet(f"{self.folder}/source")

    def create(self, start: bool = True) -> Catalog:
        source = RecordSource("list", f"{self.folder}/source", "list_*")
        self.catalog.create_table("events", SPECS["events"][0], source, start=start, refresh="100 milliseconds")
        return self.catalog

    def drain(self) -> None:
        self.catalog.start("events", refresh=None).awaitTermination()


_EVENTS = (
    "SELECT 'list_' || event_type AS _name, CAST(event_id AS VARCHAR) AS _key, "
    "event_id, ts, user_id, event_type, value, props FROM events"
)


def _shown(rows: DataFrame) -> DataFrame:
    """Typed columns, and one member that isn't declared, from the stored JSON."""
    props = F.get_json_object("_value", "$.props").alias("props")
    return rows.select("_name", "_key", "event_id", "ts", "user_id", "event_type", "value", props)


@query("stream_ingest", _EVENTS)
def stream_ingest(spark, sf_dir):
    """One arrival, one stream run that takes what is there."""
    feed = _Feed(spark, sf_dir, "stream_ingest")
    event_records(spark, sf_dir).write.parquet(f"{feed.folder}/source")
    feed.create(start=False)
    feed.drain()
    return _shown(feed.catalog.store("events").rows())


@query("ingest_resume", _EVENTS)
def ingest_resume(spark, sf_dir):
    """Three arrivals, the stream stopped and started again between them."""
    feed = _Feed(spark, sf_dir, "ingest_resume")
    for lot in range(3):
        feed.arrive(lot)
        if lot == 0:
            feed.create(start=False)
        feed.drain()
    return _shown(feed.catalog.store("events").rows())


@query(
    "stream_ingest_hash",
    "SELECT event_type AS _name, printf('%012d', event_id) AS _key, event_id, ts, user_id, event_type, value, props FROM events WHERE event_type LIKE 'p%'",
)
def stream_ingest_hash(spark, sf_dir):
    """Hashes, one for each kind of event, put in three lots by key; the stream runs between them and goes on after the last keys."""
    feed = _Feed(spark, sf_dir, "stream_ingest_hash")
    third = F.ntile(3).over(Window.partitionBy("event_type").orderBy("event_id"))
    events = table(spark, sf_dir, "events").withColumn("lot", third)
    members = ("event_id", "ts", "user_id", "event_type", "value", "props")
    for lot in (1, 2, 3):
        pairs = to_records(events.where(F.col("lot") == lot), F.col("event_type"), F.lpad(F.col("event_id").cast("string"), 12, "0"), *members)
        pairs.write.mode("append").partitionBy("_name").parquet(f"{feed.folder}/source")
        if lot == 1:
            source = RecordSource("hash", f"{feed.folder}/source", "p*", by_name=True)
            feed.catalog.create_table("events", SPECS["events"][0], source, start=False)
        feed.drain()
    return _shown(feed.catalog.store("events").rows())


@query(
    "stream_ingest_prefix",
    _EVENTS + " WHERE event_type LIKE 'p%'",
)
def stream_ingest_prefix(spark, sf_dir):
    """Lists in folders of their own, of which the stream lists and reads those with the prefix; new ones are found as it goes on."""
    feed = _Feed(spark, sf_dir, "stream_ingest_prefix")
    source = RecordSource("list", f"{feed.folder}/source", "list_p*", by_name=True)
    for lot in range(3):
        feed.arrive(lot, by_name=True)
        if lot == 0:
            feed.catalog.create_table("events", SPECS["events"][0], source, start=False)
        feed.drain()
    return _shown(feed.catalog.store("events").rows())


@query(
    "stream_fresh_page",
    "SELECT event_id, value + 1000 AS value, 'again' AS note FROM events WHERE event_type = 'view' "
    "ORDER BY events.value DESC, event_id LIMIT 40",
)
def stream_fresh_page(spark, sf_dir):
    """A page by the indexed values, its records read from the table's own source, where they have been put again since."""
    feed = _Feed(spark, sf_dir, "stream_fresh_page")
    members = ("event_id", "ts", "user_id", "event_type", "value", "props")
    events = table(spark, sf_dir, "events")
    put = [(events, members), (events.where("event_type = 'view'").withColumns({"value": F.col("value") + 1000, "note": F.lit("again")}), (*members, "note"))]
    source = RecordSource("hash", f"{feed.folder}/source", "view", by_name=True)
    for lot, (rows, names) in enumerate(put):
        pairs = to_records(rows, F.col("event_type"), F.col("event_id"), *names)
        pairs.write.mode("append").partitionBy("_name").parquet(f"{feed.folder}/source")
        if not lot:
            feed.catalog.create_table("events", SPECS["events"][0], source, start=False)
            feed.drain()
    asked = {"select": ["event_id", "value", "note"], "order_by": ["value desc", "event_id"], "size": 40}
    return feed.catalog.search("events", fresh=True, **asked).rows


@query("live_scan", 'SELECT event_type, count(*) AS "count" FROM events GROUP BY event_type')
def live_scan(spark, sf_dir):
    """Group counts asked of a running table as soon as the last lot has arrived."""
    feed = _Feed(spark, sf_dir, "live_scan")
    feed.arrive(0)
    catalog = feed.create()
    try:
        feed.arrive(1)
        feed.arrive(2)
        return catalog.search("events", group_by="event_type", wait=True).rows
    finally:
        catalog.stop("events")


@query(
    "snapshot_page",
    """
    WITH seen AS (SELECT * FROM events WHERE day(ts) <= 20 AND value > 10)
    SELECT event_id, value, (SELECT count(*) FROM seen) AS total FROM seen
    ORDER BY value DESC, event_id LIMIT 15 OFFSET 15
    """,
)
def snapshot_page(spark, sf_dir):
    """Page 2 under the token of a search made before the last lot arrived."""
    feed = _Feed(spark, sf_dir, "snapshot_page")
    feed.arrive(0)
    feed.arrive(1)
    catalog = feed.create()
    try:
        where, asked = Compare("value", ">", 10), {"select": ["event_id", "value"], "order_by": ["value desc", "event_id"]}
        first = catalog.search("events", where, wait=True, **asked)
        feed.arrive(2)
        catalog.search("events", where, wait=True, **asked)
        again = catalog.search("events", where, token=first.snapshot, page=2, **asked)
        return page_with_total(again)
    finally:
        catalog.stop("events")


@query(
    "stream_dynamic_page",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, value AS score, 'null' AS nowhere FROM events "
    "WHERE event_type = 'view' ORDER BY score DESC, event_id LIMIT 40",
)
def stream_dynamic_page(spark, sf_dir):
    """A page of a streamed table with undeclared members, fetched for the page alone."""
    feed = _Feed(spark, sf_dir, "stream_dynamic_page")
    event_records(spark, sf_dir).write.parquet(f"{feed.folder}/source")
    feed.create(start=False)
    feed.drain()
    found = feed.catalog.search(
        "events",
        Equals("event_type", "view"),
        select=["event_id", "value", "nowhere"],
        order_by=["value desc", "event_id"],
        size=40,
        missing_as_text=True,
    )
    return found.rows.select("event_id", F.col("value").cast("double").alias("score"), "nowhere")


def _document_table(spark: SparkSession, sf_dir: str, purpose: str) -> Catalog:
    folder = work_folder(spark, purpose)
    docs = table(spark, sf_dir, "documents")
    records = to_records(docs, F.lit("docs"), F.col("doc_id"), "doc_id", "text", "lang", "source", "n_chars")
    records.write.parquet(f"{folder}/source")
    catalog = Catalog(spark, f"{folder}/tables")
    source = RecordSource("list", f"{folder}/source", "docs")
    catalog.create_table("documents", SPECS["documents"][0], source, start=False)
    catalog.start("documents", refresh=None).awaitTermination()
    return catalog


@query(
    "stream_text_search",
    f"""
    WITH {BM25_CTE}
    SELECT doc_id, lang, (SELECT count(DISTINCT doc_id) FROM part WHERE t IN ('from', 'ha')) AS total
    FROM part JOIN documents USING (doc_id)
    WHERE t IN ('from', 'ha') GROUP BY doc_id, lang
    """,
)
def stream_text_search(spark, sf_dir):
    """All hits of a streamed table by relevance, from token arrays stored at ingest."""
    catalog = _document_table(spark, sf_dir, "stream_text_search")
    return page_with_total(catalog.search("documents", MatchAny("text", "from ha"), ["doc_id", "lang"], size=None))


@query(
    "stream_indexed_search",
    f"""
    WITH {BM25_CTE},
    hit AS (
        SELECT doc_id, lang, sum(s) AS s FROM part JOIN documents USING (doc_id)
        WHERE t IN ('from', 'ha') AND n_chars > 300 GROUP BY doc_id, lang
    )
    SELECT doc_id, lang, (SELECT count(*) FROM hit) AS total FROM hit
    """,
)
def stream_indexed_search(spark, sf_dir):
    """The same kind of search read from stored postings of the searched terms."""
    catalog = _document_table(spark, sf_dir, "stream_indexed_search")
    catalog.index_text("documents", "text", buckets=64)
    where = MatchAny("text", "from ha") & Compare("n_chars", ">", 300)
    return page_with_total(catalog.search("documents", where, ["doc_id", "lang"], size=None))


@query(
    "stream_wildcard_search",
    f"""
    WITH {BM25_CTE},
    hit AS (
        SELECT DISTINCT doc_id, lang FROM part JOIN documents USING (doc_id)
        WHERE regexp_matches(t, '^(con.*er|[^ ]at|.*ung)$') AND n_chars > 300
    )
    SELECT doc_id, lang, (SELECT count(*) FROM hit) AS total FROM hit
    """,
)
def stream_wildcard_search(spark, sf_dir):
    """Wildcards on a stored index: the dictionary gives the terms that fit, and their buckets alone are read."""
    catalog = _document_table(spark, sf_dir, "stream_wildcard_search")
    catalog.index_text("documents", "text", buckets=64)
    where = (Like("text", "con*er") | Like("text", "?at") | Like("text", "*ung")) & Compare("n_chars", ">", 300)
    return page_with_total(catalog.search("documents", where, ["doc_id", "lang"], size=None))


@query(
    "stream_compacted",
    """
    SELECT event_id, value, (SELECT count(*) FROM events WHERE day(ts) <= 20) AS total FROM events WHERE day(ts) <= 20
    ORDER BY value DESC, event_id LIMIT 30 OFFSET 60
    """,
)
def stream_compacted(spark, sf_dir):
    """A page under an old token, after many small batches have been rewritten, those of the token and later ones together."""
    feed = _Feed(spark, sf_dir, "stream_compacted")
    feed.arrive(0)
    feed.create(start=False)
    feed.catalog.start("events", refresh=None, files_per_batch=1).awaitTermination()
    feed.arrive(1)
    catalog = feed.catalog
    catalog.start("events", refresh="100 milliseconds", files_per_batch=1)
    try:
        asked = {"select": ["event_id", "value"], "order_by": ["value desc", "event_id"], "size": 30}
        first = catalog.search("events", wait=True, **asked)
        feed.arrive(2)
        catalog.wait_for_arrived("events")
        for _ in range(2):
            catalog.compact("events", batches=1)
        return page_with_total(catalog.search("events", token=first.snapshot, page=3, **asked))
    finally:
        catalog.stop("events")
