import json
import os
import shutil
import threading
import time
from types import SimpleNamespace

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tarnseek import (
    Catalog,
    Compare,
    Equals,
    Field,
    Kind,
    Like,
    MatchAll,
    MatchAny,
    Phrase,
    RecordSource,
    TableSpec,
    TarnseekError,
    search_view,
)
from tarnseek.functions.analyzers import Analyzer, STANDARD, register_analyzer, reset_analyzers
from tarnseek.operators.postings import glob_trigrams
from tarnseek.sources.decode import decode_records
from tarnseek.sources.records import hash_range, list_range, name_matches, read_records, stream_records
from tarnseek.sources.storage import Folder, work_folder
from tarnseek.streaming.feed import TableStore
from tarnseek.streaming.text_index import TextIndex

FIELDS = [("index", "int"), ("city", "string"), ("company", "text"), ("time", "date", "uuuu-MM-dd'T'HH:mm:ss.SSSSSS"),
          ("timestamp", "long")]


def record(i, city="hangzhou", **more):
    value = {"index": i, "company": "北京三维力控科技有限公司", "time": f"2019-02-27T23:15:34.{i:06d}",
             "city": city, "timestamp": str(1551280534406 + i), **more}
    return ("listTest", str(i), json.dumps(value, ensure_ascii=False))


def arrive(spark, folder, rows):
    df = spark.createDataFrame(rows, "_name string, _key string, value string")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/source")


@pytest.fixture
def made(spark, tmp_path):
    """A catalog and a source folder with 20 records."""
    arrive(spark, tmp_path, [record(i) for i in range(20)])
    catalog = Catalog(spark, f"{tmp_path}/tables", search_expired=60)
    yield catalog, RecordSource("list", f"{tmp_path}/source", "list*"), tmp_path
    for query in spark.streams.active:
        query.stop()


def drain(catalog, name="t", **options):
    catalog.start(name, refresh=None, **options).awaitTermination()


def keys(df):
    return sorted(int(r["_key"]) for r in df.select("_key").collect())


# --- table life ---------------------------------------------------------------------
def test_create_describe_list_stop_drop(spark, made):
    catalog, source, _ = made
    assert catalog.tables().collect() == []
    catalog.create_table("t", FIELDS, source, refresh="100 milliseconds")
    assert catalog.describe("t").field("time").pattern == FIELDS[3][2]
    assert [(r["name"], r["source_name"], r["running"]) for r in catalog.tables().collect()] == [("t", "list*", True)]
    with pytest.raises(TarnseekError):
        catalog.create_table("t", FIELDS, source)
    with pytest.raises(TarnseekError):
        catalog.start("t")
    with pytest.raises(TarnseekError):
        catalog.drop("t")
    catalog.stop("t")
    assert [r["running"] for r in catalog.tables().collect()] == [False]
    assert catalog.view("t").df.count() == 20
    with pytest.raises(TarnseekError):
        catalog.stop("t")
    catalog.drop("t")
    assert catalog.tables().collect() == []
    with pytest.raises(TarnseekError):
        catalog.describe("t")


def test_wrong_definitions(spark, made):
    catalog, source, folder = made
    for fields in ([("a", "float")], [("_a", "int")], [("a", "int"), ("a", "long")], [("a__tokens", "int")]):
        with pytest.raises(TarnseekError):
            catalog.create_table("t", fields, source)
    for bad in (("queue", "x", "n"), ("list", "", "n"), ("list", "x", "")):
        with pytest.raises(TarnseekError):
            RecordSource(*bad)
    with pytest.raises(TarnseekError):
        catalog.create_table("t", FIELDS, RecordSource("list", f"{folder}/nowhere", "n"))
    with pytest.raises(TarnseekError):
        catalog.create_table("t", FIELDS, source, analyzer="nope")
    with pytest.raises(TarnseekError):
        catalog.create_table("a/b", FIELDS, source)
    assert catalog.tables().collect() == []


def test_analyzer_is_frozen_at_create(spark, made):
    catalog, source, _ = made
    try:
        register_analyzer("mine", Analyzer("mine", lowercase=False))
        catalog.create_table("t", FIELDS, source, analyzer="MINE", start=False)
        register_analyzer("mine", STANDARD)
        assert catalog.describe("t").analyzer.lowercase is False
    finally:
        reset_analyzers()


def test_an_analyzer_of_ones_own(spark, made):
    """Any expression from text to tokens; the table keeps its name, and needs it to be opened."""
    catalog, source, folder = made
    arrive(spark, folder, [record(70, company="Étés très chauds"), record(71, company="winters")])
    register_analyzer("stems", lambda text: F.transform(F.split(F.lower(text), " "), lambda w: F.when(F.length(w) > 2, F.regexp_replace(w, "s$", ""))))
    try:
        catalog.create_table("t", FIELDS, source, analyzer="stems", start=False)
        catalog.create_table("f", FIELDS, source, analyzer="folded", start=False)
        for name in ("t", "f"):
            drain(catalog, name)
        for stored in (True, False):
            if stored:
                hits = [catalog.search("t", MatchAll("company", "Winter"), ["index"]), catalog.search("t", Like("company", "w*er"), ["index"]),
                        catalog.search("f", Phrase("company", "ETES tres"), ["index"]), catalog.search("t", MatchAny("company", "chaud"), ["index"])]
            else:
                catalog.index_text("t", "company", buckets=4)
                catalog.index_text("f", "company", buckets=4)
                hits = [catalog.search("t", MatchAll("company", "Winter"), ["index"]), catalog.search("t", Like("company", "w*er"), ["index"]),
                        catalog.search("f", Phrase("company", "ETES tres"), ["index"]), catalog.search("t", MatchAny("company", "chaud"), ["index"])]
            assert [[r["index"] for r in h.rows.collect()] for h in hits] == [[71], [71], [70], [70]]
        assert catalog.describe("t").analyzer.name == "stems"
    finally:
        reset_analyzers()
    with pytest.raises(TarnseekError):
        catalog.describe("t")
    assert catalog.describe("f").analyzer.name == "folded"


def test_search_a_stopped_table(spark, made):
    catalog, source, _ = made
    catalog.create_table("t", FIELDS, source, start=False)
    assert catalog.search("t").total == 0
    drain(catalog)
    found = catalog.search("t", Equals("company", "北") & Compare("timestamp", ">=", 1551280534406 + 5),
                           select=["index", "time"], order_by=["index desc"], size=3)
    assert found.total == 15 and found.snapshot is None
    assert [r["index"] for r in found.rows.collect()] == [19, 18, 17]
    assert json.loads(found.envelope())["results"][0]["time"] == "2019-02-27T23:15:34.000019"


def test_undeclared_and_missing_members(spark, made):
    catalog, source, folder = made
    arrive(spark, folder, [record(20, extra={"deep": [1]}, nothing=None)])
    catalog.create_table("t", FIELDS, source, start=False)
    drain(catalog)
    asked = dict(select=["index", "extra", "nothing"], order_by=["index desc"], size=2)
    plain = [tuple(r) for r in catalog.search("t", **asked).rows.collect()]
    assert plain == [(20, '{"deep":[1]}', None), (19, None, None)]
    as_text = [tuple(r) for r in catalog.search("t", missing_as_text=True, **asked).rows.collect()]
    assert as_text == [("20", '{"deep":[1]}', None), ("19", "null", "null")]


def test_current_records_are_fetched_by_key(spark, made):
    catalog, source, _ = made
    catalog.create_table("t", FIELDS, source, start=False)
    drain(catalog)
    kept = [(n, k, v.replace("hangzhou", "moved")) for n, k, v in (record(i) for i in range(0, 20, 2))]
    records = spark.createDataFrame(kept, "_name string, _key string, value string")
    found = catalog.search("t", order_by=["index"], size=5, select=["index", "city"], records=records, missing_as_text=True)
    assert found.total == 20
    assert [tuple(r) for r in found.rows.collect()] == [("0", "moved"), ("2", "moved"), ("4", "moved")]


def test_fresh_records_come_from_the_tables_own_source(spark, made):
    catalog, source, folder = made
    catalog.create_table("t", FIELDS, source, start=False)
    drain(catalog)
    time.sleep(1.1)
    arrive(spark, folder, [record(i, city="moved", extra=i) for i in range(0, 20, 2)])
    asked = dict(order_by=["index"], size=4, select=["index", "city", "extra"])
    assert [tuple(r) for r in catalog.search("t", **asked).rows.collect()] == [(i, "hangzhou", None) for i in range(4)]
    found = catalog.search("t", fresh=True, **asked)
    assert [tuple(r) for r in found.rows.collect()] == [(0, "moved", "0"), (1, "hangzhou", None), (2, "moved", "2"), (3, "hangzhou", None)]
    assert found.total == 20
    # The page's keys are in the scan of the records, and the hits aren't joined to themselves.
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert "_key#" in plan and "IN (0,1,2,3)" in plan.replace(", ", ",").replace(" IN ", " IN ")
    own = catalog.search("t", Equals("city", "hangzhou"), order_by=["index"], size=2, select=["extra"]).rows
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "city" not in plan and "_batch_id" in plan.split("PartitionFilters")[1]


# --- exactly once -----------------------------------------------------------------------
def test_resume_takes_each_record_once(spark, made):
    catalog, source, folder = made
    catalog.create_table("t", FIELDS, source, start=False)
    drain(catalog)
    drain(catalog)
    arrive(spark, folder, [record(i) for i in range(20, 30)])
    drain(catalog)
    assert keys(catalog.view("t").df) == list(range(30))


def test_replayed_batches_land_once(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/t", TableSpec("t", tuple(Field(*f) for f in FIELDS)))
    first = spark.createDataFrame([record(1), record(2)], "_name string, _key string, value string")
    store.append(first, 0)
    store.append(first, 0)
    # A batch written but not noted as committed isn't seen, and is overwritten when replayed.
    decode_records(first, store.spec).withColumn("_row", F.lit(0).cast("long")).write.partitionBy("_status").parquet(
        f"{tmp_path}/t/data/_batch_id=1"
    )
    assert keys(store.rows()) == [1, 2]
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        store.append(spark.createDataFrame([record(3)], first.schema), 1)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert keys(store.rows()) == [1, 2, 3]
    assert keys(store.rows(up_to=0)) == [1, 2]


def test_a_lost_checkpoint_is_noticed(spark, made):
    catalog, source, _ = made
    catalog.create_table("t", FIELDS, source, start=False)
    drain(catalog)
    catalog.store("t").folder.child("checkpoint").remove()
    with pytest.raises(TarnseekError):
        catalog.start("t")


def test_append_keeps_rows_with_the_same_key(spark, made):
    catalog, source, folder = made
    arrive(spark, folder, [record(3), record(3)])
    catalog.create_table("t", FIELDS, source, start=False)
    drain(catalog)
    assert catalog.search("t", Equals("index", 3)).total == 3


def test_bad_records_go_to_quarantine(spark, made):
    catalog, source, folder = made
    bad = [("listTest", "90", '{"index":'), ("listTest", "91", json.dumps({"index": "x"})), (None, "92", "{}"),
           ("listTest", "93", json.dumps({"index": "7", "city": None}))]
    arrive(spark, folder, bad)
    catalog.create_table("t", FIELDS, source, start=False)
    drain(catalog)
    assert keys(catalog.view("t").df) == [*range(20), 93]
    reasons = {r["_key"]: r["_error"] for r in catalog.store("t").quarantine().collect()}
    assert reasons == {"90": "not a JSON object", "91": "index: not a int: x"}


def test_fail_on_bad_value(spark, made):
    catalog, source, folder = made
    arrive(spark, folder, [("listTest", "91", json.dumps({"index": "x"}))])
    catalog.create_table("t", FIELDS, source, start=False)
    with pytest.raises(StreamingQueryException):
        drain(catalog, on_bad_value="fail")
    drain(catalog, on_bad_value="null")
    assert catalog.view("t").df.where("index is null").count() == 1


def test_other_sources_are_left_alone(spark, made):
    catalog, source, folder = made
    arrive(spark, folder, [("other", "1", "{}")])
    catalog.create_table("t", FIELDS, source, start=False)
    drain(catalog)
    assert catalog.view("t").df.count() == 20


# --- live reads and tokens -----------------------------------------------------------------
def test_live_search_sees_what_arrived_and_tokens_keep_pages_steady(spark, made):
    catalog, source, folder = made
    catalog.create_table("t", FIELDS, source, refresh="100 milliseconds")
    asked = dict(order_by=["index desc"], select=["index"], size=5)
    first = catalog.search("t", wait=True, **asked)
    assert first.total == 20 and first.snapshot == 0
    arrive(spark, folder, [record(i) for i in range(20, 40)])
    fresh = catalog.search("t", wait=True, **asked)
    assert fresh.total == 40 and fresh.snapshot == 1
    steady = catalog.search("t", token=first.snapshot, page=2, **asked)
    assert steady.total == 20 and steady.snapshot == 0
    assert [r["index"] for r in steady.rows.collect()] == [14, 13, 12, 11, 10]
    assert json.loads(steady.envelope())["key"] == 0
    groups = catalog.search("t", group_by="city", token=first.snapshot)
    assert [tuple(r) for r in groups.rows.collect()] == [("hangzhou", 20)]


def test_tokens_expire(spark, made):
    catalog, source, _ = made
    catalog.create_table("t", FIELDS, source, refresh="100 milliseconds")
    short = Catalog(spark, catalog.root.path, search_expired=0.5)
    token = short.search("t", wait=True).snapshot
    assert short.search("t", token=token).total == 20
    time.sleep(2)
    with pytest.raises(TarnseekError):
        short.search("t", token=token)
    assert short.search("t").snapshot == token
    assert short.search("t", token=token).total == 20
    with pytest.raises(TarnseekError):
        short.search("t", token=77)


def test_tokens_can_be_off(spark, made):
    catalog, source, _ = made
    catalog.create_table("t", FIELDS, source, refresh="100 milliseconds")
    off = Catalog(spark, catalog.root.path)
    assert off.search("t").snapshot == -1
    with pytest.raises(TarnseekError):
        off.search("t", token=0)


def test_stored_tokens_answer_text_searches(spark, made):
    catalog, source, folder = made
    arrive(spark, folder, [record(50, company="上海 power"), record(51, company="Power power")])
    catalog.create_table("t", FIELDS, source, start=False)
    drain(catalog)
    found = catalog.search("t", MatchAny("company", "POWER"), ["index"])
    assert [r["index"] for r in found.rows.collect()] == [51, 50]
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_groups_of_a_stored_table_are_hashed(spark, made):
    catalog, source, folder = made
    arrive(spark, folder, [record(30, city="aa"), record(31)])
    catalog.create_table("t", FIELDS, source, start=False)
    drain(catalog)
    found = catalog.search("t", group_by="city")
    assert [tuple(r) for r in found.rows.collect()] == [("hangzhou", 21), ("aa", 1)]
    assert "SortAggregate" not in found.rows._jdf.queryExecution().executedPlan().toString()


# --- sources -------------------------------------------------------------------------------
def test_source_scans(spark):
    rows = [("list1", str(i), "{}") for i in range(12)] + [("h1", f"key_{i}", "{}") for i in range(12)]
    df = spark.createDataFrame(rows, "_name string, _key string, value string")
    assert keys(list_range(df, "list1", 9, 2)) == [9, 10]
    assert [r["_key"] for r in hash_range(df, "h1", "key_10", 2).collect()] == ["key_11", "key_2"]
    assert df.where(name_matches("li*")).count() == 12
    assert df.where(name_matches("li")).count() == 0
    for wrong in (lambda: list_range(df, "l", -1, 5), lambda: hash_range(df, "h", "", 0)):
        with pytest.raises(TarnseekError):
            wrong()


def session_like(master, shared):
    conf = SimpleNamespace(get=lambda key, default: shared or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_work_folder_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert work_folder(spark, "x").startswith(f"{shared}/x-")
    assert work_folder(session_like("yarn", "hdfs://nn/shared/"), "x").startswith("hdfs://nn/shared/x-")
    assert "tarnseek-" in work_folder(session_like("local[2]", None), "x")
    with pytest.raises(TarnseekError):
        work_folder(session_like("spark://host:7077", None), "x")


def test_small_files_are_written_once(spark, tmp_path):
    folder = Folder(spark, f"{tmp_path}/small")
    assert folder.put_new("a", "één") and not folder.put_new("a", "other")
    assert folder.names() == ["a"] and folder.text("a") == "één"


def test_kinds():
    assert Field("a", "TEXT").kind is Kind.TEXT


# --- stored postings -------------------------------------------------------------------------
WORDS = ["red", "cat", "sat", "on", "the", "mat", "dog", "power"]


def story(i):
    text = " ".join(WORDS[(i * k + k * k) % len(WORDS)] for k in range(1, 4 + i % 9))
    return record(i, city="hz" if i % 3 else "bj", company=text)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """60 records in three batches: two indexed, the last one not yet."""
    tmp_path = tmp_path_factory.mktemp("indexed")
    catalog = Catalog(spark, f"{tmp_path}/tables", search_expired=60)
    arrive(spark, tmp_path, [story(i) for i in range(20)])
    catalog.create_table("t", FIELDS, RecordSource("list", f"{tmp_path}/source", "list*"), start=False)
    for lot in range(3):
        if lot:
            arrive(spark, tmp_path, [story(i) for i in range(20 * lot, 20 * lot + 20)])
        drain(catalog)
        if lot < 2:
            assert catalog.index_text("t", "company", buckets=4) == lot
    return catalog


@pytest.mark.parametrize(
    "where",
    [
        Equals("company", "cat"),
        Equals("company", "nowhere"),
        MatchAny("company", "Cat the POWER"),
        MatchAll("company", "cat dog"),
        Phrase("company", "red cat"),
        Phrase("company", "sat on the mat"),
        Like("company", "?at"),
        Like("company", "p*r"),
        Like("company", "*"),
        Like("company", "*o*"),
        Like("company", "dog"),
        Like("company", "nothing*"),
        Like("company", "") | Like("company", "\\*"),
        Equals("company", "cat") & Equals("city", "hz") & Compare("index", ">", 7),
        (Equals("company", "cat") & MatchAny("company", "dog")) | Equals("company", "power"),
        Equals("company", "cat") | Equals("city", "bj"),
    ],
)
def test_index_gives_the_same_answers(spark, indexed, where):
    store = indexed.store("t")
    asked = dict(select=["index", "city", "company"], size=100)
    for up_to in (0, 2):
        plain = search_view(indexed.view("t", up_to), where, **asked)
        view = indexed.view("t", up_to)
        with_index = search_view(view, where, indexes=indexed._indexes(store, where, view, up_to), **asked)
        assert [tuple(r) for r in with_index.rows.collect()] == [tuple(r) for r in plain.rows.collect()]
        assert with_index.total == plain.total


def test_a_wildcard_reads_the_buckets_of_its_terms(spark, indexed):
    """The dictionary is read by one trigram's bucket, and the postings by the buckets of the terms found there."""
    assert indexed.index_text("t", "company") == 2
    store, view = indexed.store("t"), indexed.view("t", 2)
    [source] = indexed._indexes(store, Like("company", "po*er"), view, 2).values()
    found = source.postings_like("po*er")
    assert {r["term"] for r in found.collect()} == {"power"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "_grams" in plan
    terms = source._index._dictionary.like(spark, "po*er").select("term", "rows").distinct().collect()
    assert {r["term"] for r in terms} == {"power"} and sum(r["rows"] for r in terms) >= 1


def test_trigrams_of_globs():
    edge = "\x02", "\x03"
    assert glob_trigrams("*a*") == [] and glob_trigrams("*") == [] and glob_trigrams("") == []
    assert glob_trigrams("?at") == [f"at{edge[1]}"]
    assert glob_trigrams("ab*") == [f"{edge[0]}ab"]
    assert glob_trigrams("\\*ab?cde") == [f"{edge[0]}*a", "*ab", "cde", f"de{edge[1]}"]


def test_index_spares_the_token_arrays(spark, indexed):
    assert indexed.index_text("t", "company") == 2
    found = indexed.search("t", MatchAny("company", "cat power"), ["index"])
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert "company__tokens" not in plan
    assert found.total > 0
    bounded = indexed.search("t", MatchAny("company", "cat power"), ["index"], size=2, score_bounds=True)
    assert bounded.rows.collect() == found.rows.collect()[:2] and bounded.total == found.total
    with pytest.raises(TarnseekError):
        indexed.index_text("t", "city")


class _Interrupted(Exception):
    pass


def test_index_after_an_interrupted_update(spark, tmp_path, monkeypatch):
    """An update dies before it is noted; more rows come; the next one must not count its leavings."""
    catalog = Catalog(spark, f"{tmp_path}/tables")
    arrive(spark, tmp_path, [story(i) for i in range(20)])
    catalog.create_table("t", FIELDS, RecordSource("list", f"{tmp_path}/source", "list*"), start=False)
    drain(catalog)

    def die(self, name, text=""):
        if self.path.endswith("updates"):
            raise _Interrupted
        return put_new(self, name, text)

    put_new = Folder.put_new
    monkeypatch.setattr(Folder, "put_new", die)
    with pytest.raises(_Interrupted):
        catalog.index_text("t", "company", buckets=4)
    monkeypatch.setattr(Folder, "put_new", put_new)
    arrive(spark, tmp_path, [story(i) for i in range(20, 30)])
    drain(catalog)
    assert catalog.index_text("t", "company") == 1
    view, store = catalog.view("t"), catalog.store("t")
    where = MatchAny("company", "cat power")
    plain = search_view(view, where, ["index"], size=None)
    with_index = search_view(view, where, ["index"], size=None, indexes=catalog._indexes(store, where, view, 1))
    assert with_index.total == plain.total > 0
    assert [tuple(r) for r in with_index.rows.collect()] == [tuple(r) for r in plain.rows.collect()]


def test_leavings_of_an_update_are_not_read(spark, indexed):
    """Parts that nobody noted, written beside the noted ones."""
    folder = indexed.store("t").folder.child("index/company")
    for name in ("terms", "sizes"):
        path = f"{folder.path}/{name}"
        writer = spark.read.option("basePath", f"{path}/_upto=0").parquet(f"{path}/_upto=0").write
        (writer.partitionBy("_bucket") if name == "terms" else writer).parquet(f"{path}/_upto=7")
    where = Equals("company", "cat")
    assert indexed.search("t", where, ["index"]).total == search_view(indexed.view("t"), where, ["index"]).total
    assert indexed.index_text("t", "company") == 2
    assert "_upto=7" not in folder.child("terms").names() + folder.child("sizes").names()


def test_long_phrases_with_and_without_an_index(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(90))
    catalog = Catalog(spark, f"{tmp_path}/tables")
    arrive(spark, tmp_path, [record(0, company=f"start {words} end"), record(1, company=words.replace("w80", "other")), record(2, company=f"{words} {words}")])
    catalog.create_table("t", FIELDS, RecordSource("list", f"{tmp_path}/source", "list*"), start=False)
    drain(catalog)
    for where, hits in ((Phrase("company", words), [0, 2]), (MatchAll("company", words), [0, 2])):
        plain = catalog.search("t", where, ["index"], order_by=["index"])
        catalog.index_text("t", "company", buckets=4)
        found = catalog.search("t", where, ["index"], order_by=["index"])
        assert [r["index"] for r in plain.rows.collect()] == [r["index"] for r in found.rows.collect()] == hits


def test_search_and_stop_return_while_a_feed_keeps_coming(spark, made):
    catalog, source, folder = made
    catalog.create_table("t", FIELDS, source, refresh="100 milliseconds")
    going = threading.Event()

    def feed():
        i = 100
        while not going.is_set() and i < 400:
            arrive(spark, folder, [record(i)])
            i += 1

    thread = threading.Thread(target=feed)
    thread.start()
    try:
        start = time.monotonic()
        assert catalog.search("t").total >= 0
        assert catalog.search("t", wait=True, wait_seconds=60).total >= 20
        catalog.stop("t", wait_seconds=60)
        assert time.monotonic() - start < 60 and thread.is_alive()
    finally:
        going.set()
        thread.join()


def test_waiting_has_an_end(spark, made):
    catalog, source, _ = made
    catalog.create_table("t", FIELDS, source, start=False)
    drain(catalog)
    catalog.start("t", refresh="1 hour")
    arrive(spark, source.path.rsplit("/", 1)[0], [record(77)])
    with pytest.raises(TarnseekError):
        catalog.search("t", wait=True, wait_seconds=1)
    with pytest.raises(TarnseekError):
        catalog.stop("t", wait_seconds=1)
    assert not catalog.is_running("t")


# --- what counts as arrived ------------------------------------------------------------------
def test_old_files_are_taken_and_waited_for(spark, made):
    """A backfill: its files' times lie days before those already read."""
    catalog, source, folder = made
    catalog.create_table("t", FIELDS, source, refresh="100 milliseconds")
    assert catalog.search("t", wait=True).total == 20
    arrive(spark, f"{folder}/elsewhere", [record(20)])
    [new] = [f for f in os.listdir(f"{folder}/elsewhere/source") if f.startswith("part-")]
    long_ago = time.time() - 9 * 86_400
    os.utime(f"{folder}/elsewhere/source/{new}", (long_ago, long_ago))
    shutil.copy2(f"{folder}/elsewhere/source/{new}", f"{folder}/source/{new}")
    assert catalog.search("t", wait=True).total == 21
    arrive(spark, folder, [record(21)])
    catalog.stop("t")
    assert keys(catalog.view("t").df) == list(range(22))


def test_a_limit_on_the_age_of_files_can_be_set(spark, made):
    catalog, source, folder = made
    catalog.create_table("t", FIELDS, source, start=False)
    drain(catalog)
    arrive(spark, folder, [record(20)])
    long_ago = time.time() - 9 * 86_400
    for f in os.listdir(f"{folder}/source"):
        os.utime(f"{folder}/source/{f}", (long_ago, long_ago))
    arrive(spark, folder, [record(21)])
    drain(catalog, files_per_batch=1, file_age="7d")
    drain(catalog, files_per_batch=1, file_age="7d")
    assert 21 in keys(catalog.view("t").df)
    assert catalog.view("t").df.count() >= 21


def test_waiting_asks_the_driver_nothing_about_files(spark, made, monkeypatch):
    """Neither the source nor the stream's own log is listed or read, with however many files."""
    catalog, source, folder = made
    spark.createDataFrame([record(i) for i in range(20, 320)], "_name string, _key string, value string").repartition(300).write.mode("append").parquet(f"{folder}/source")
    catalog.create_table("t", FIELDS, source, refresh="100 milliseconds")
    touched = []
    for name in ("text", "entries"):
        usual = getattr(Folder, name)
        monkeypatch.setattr(Folder, name, lambda self, *a, usual=usual, name=name: touched.append((name, self.path, *a)) or usual(self, *a))
    monkeypatch.setattr(type(spark.read), "load", lambda *a, **k: pytest.fail("the source is read by the driver"))
    catalog.wait_for_arrived("t")
    assert all(path.endswith(("/commits", "/t")) for _, path, *_ in touched) and len(touched) < 10
    monkeypatch.undo()
    assert catalog.search("t").total == 320


def test_waiting_for_a_failed_stream_says_so(spark, made):
    catalog, source, folder = made
    catalog.create_table("t", FIELDS, source, refresh="100 milliseconds", on_bad_value="fail")
    catalog.search("t", wait=True)
    arrive(spark, folder, [("listTest", "91", json.dumps({"index": "x"}))])
    with pytest.raises(TarnseekError):
        for _ in range(100):
            catalog.search("t", wait=True, wait_seconds=30)


# --- hashes ------------------------------------------------------------------------------------
def put(spark, folder, pairs, by_name=True):
    df = spark.createDataFrame([(n, k, json.dumps({"index": i})) for n, k, i in pairs], "_name string, _key string, value string").coalesce(1)
    (df.write.mode("append").partitionBy("_name") if by_name else df.write.mode("append")).parquet(f"{folder}/hashes")


def pairs_of(df):
    return sorted((r["_name"], r["_key"], r["index"]) for r in df.select("_name", "_key", "index").collect())


@pytest.mark.parametrize("by_name", [True, False])
def test_hashes_stream_by_their_keys(spark, tmp_path, by_name):
    """Keys go on after the last one taken, each hash on its own; new hashes are found; others are left alone."""
    first = [("h1", "key_1", 1), ("h1", "key_10", 10), ("h2", "a", 2), ("other", "x", 3)]
    put(spark, tmp_path, first, by_name)
    catalog = Catalog(spark, f"{tmp_path}/tables", search_expired=60)
    catalog.create_table("t", [("index", "int")], RecordSource("hash", f"{tmp_path}/hashes", "h*", by_name=by_name), start=False)
    drain(catalog)
    assert pairs_of(catalog.view("t").df) == first[:3]
    more = [("h1", "key_2", 20), ("h2", "b", 4), ("h3", "0", 5), ("h1", "key_0", 99)]
    put(spark, tmp_path, more, by_name)
    drain(catalog)
    drain(catalog)
    # key_0 comes before what was taken, and a scan by key has passed it.
    assert pairs_of(catalog.view("t").df) == sorted(first[:3] + more[:3])
    catalog.start("t", refresh="100 milliseconds")
    put(spark, tmp_path, [("h3", "1", 6), ("h3", "10", 7)], by_name)
    assert catalog.search("t", wait=True).total == 8
    catalog.stop("t")
    with pytest.raises(TarnseekError):
        RecordSource("hash", "x", "h", format="json")


def test_a_killed_hash_stream_goes_on(spark, tmp_path, monkeypatch):
    """It dies after a batch is planned and written, before it is noted; the next run takes the same keys again, once."""
    put(spark, tmp_path, [("h1", f"k{i:03}", i) for i in range(50)])
    catalog = Catalog(spark, f"{tmp_path}/tables")
    catalog.create_table("t", [("index", "int")], RecordSource("hash", f"{tmp_path}/hashes", "h1", by_name=True), start=False)
    drain(catalog)
    put(spark, tmp_path, [("h1", f"k{i:03}", i) for i in range(50, 80)])

    def die(self, batch):
        raise _Interrupted

    with monkeypatch.context() as patched:
        patched.setattr("tarnseek.streaming.snapshots.SnapshotLog.commit", die)
        with pytest.raises(StreamingQueryException):
            drain(catalog)
    put(spark, tmp_path, [("h1", f"k{i:03}", i) for i in range(80, 90)])
    # The planned batch is done over with the end it had; what came later is for the run after it.
    drain(catalog)
    assert pairs_of(catalog.view("t").df) == [("h1", f"k{i:03}", i) for i in range(80)]
    drain(catalog)
    assert pairs_of(catalog.view("t").df) == [("h1", f"k{i:03}", i) for i in range(90)]


def test_awkward_hash_files(spark, tmp_path):
    """Null keys and names, several names in a row group, an empty file, letters beyond ASCII, names that folders spell otherwise."""
    rows = [("h", None, "{}"), (None, "k", "{}"), ("h", "é", "{}"), ("h", "z", "{}"), ("h", "", "{}"), ("h:=/1 ", "k", None), ("g", "k", "{}")]
    df = spark.createDataFrame(rows, "_name string, _key string, value string")
    df.coalesce(1).write.parquet(f"{tmp_path}/flat")
    df.where("false").coalesce(1).write.mode("append").parquet(f"{tmp_path}/flat")
    df.coalesce(1).write.partitionBy("_name").parquet(f"{tmp_path}/named")
    for folder in ("flat", "named"):
        out = f"{tmp_path}/out-{folder}"
        stream = stream_records(spark, RecordSource("hash", f"{tmp_path}/{folder}", "h*"))
        stream.writeStream.option("checkpointLocation", f"{out}-c").format("parquet").trigger(availableNow=True).start(out).awaitTermination()
        got = {(r["_name"], r["_key"], r["value"]) for r in spark.read.parquet(out).collect()}
        assert got == {("h", "é", "{}"), ("h", "z", "{}"), ("h", "", "{}"), ("h:=/1 ", "k", None)}


# --- sources by name ---------------------------------------------------------------------------
def test_only_folders_of_matching_names_are_read(spark, tmp_path):
    rows = [("list_a", "1", "{}"), ("list:b", "2", "{}"), ("other", "3", "{}")]
    df = spark.createDataFrame(rows, "_name string, _key string, value string")
    df.write.partitionBy("_name").parquet(f"{tmp_path}/feed")
    with open(f"{tmp_path}/feed/_name=other/part-broken.parquet", "w") as f:
        f.write("not parquet")
    for pattern, names in (("list*", ["list:b", "list_a"]), ("list:*", ["list:b"]), ("list_a", ["list_a"])):
        source = RecordSource("list", f"{tmp_path}/feed", pattern, by_name=True)
        assert sorted(r["_name"] for r in read_records(spark, source).collect()) == names
        catalog = Catalog(spark, f"{tmp_path}/tables-{len(names)}-{pattern[-1] == "*"}")
        catalog.create_table("t", [("index", "int")], source, start=False)
        drain(catalog)
        assert sorted(r["_name"] for r in catalog.view("t").df.collect()) == names
    late = spark.createDataFrame([("list_z", "4", "{}")], "_name string, _key string, value string")
    late.write.mode("append").partitionBy("_name").parquet(f"{tmp_path}/feed")
    catalog = Catalog(spark, f"{tmp_path}/tables-2-True")
    drain(catalog)
    assert sorted(r["_name"] for r in catalog.view("t").df.collect()) == ["list:b", "list_a", "list_z"]


# --- rewriting of small batches ----------------------------------------------------------------
def test_many_batches_are_rewritten_and_tokens_stay_valid(spark, tmp_path):
    catalog = Catalog(spark, f"{tmp_path}/tables", search_expired=600)
    (tmp_path / "source").mkdir()
    catalog.create_table("t", FIELDS, RecordSource("list", f"{tmp_path}/source", "list*"), start=False)
    store = catalog.store("t")
    schema = "_name string, _key string, value string"
    seen = []
    for batch in range(60):
        rows = [story(2 * batch), story(2 * batch + 1)] + ([("listTest", "bad", "{")] if batch % 7 == 0 else [])
        store.append(spark.createDataFrame(rows, schema).coalesce(1), batch)
        if batch in (3, 11, 29):
            catalog.index_text("t", "company", buckets=2)
            TextIndex(store, "company", 2).merge(updates=2, fan=2)
        if batch % 4 == 3:
            store.compact(4, fan=3)
        if batch % 13 == 0:
            seen.append((batch, keys(store.rows())))
    store.compact(4, fan=3)
    names = store.folder.child("data").names() + store.folder.child("compact").names()
    assert len(names) <= 8 and store.ranges.live()[0].tier >= 2
    for batch, before in seen:
        assert keys(store.rows(up_to=batch)) == before == list(range(2 * batch + 2))
    assert keys(store.rows()) == list(range(120)) and store.quarantine().count() == 9
    assert store.rows().select("_batch_id", "_row").distinct().count() == 120
    index = TextIndex(store, "company", 2)
    assert len(index.live()) <= 2 and index.covered() == 29
    for where in (MatchAny("company", "cat power"), Like("company", "?at"), Phrase("company", "red cat")):
        for up_to in (17, 59):
            view = catalog.view("t", up_to)
            plain = search_view(view, where, ["index"], size=None)
            found = search_view(view, where, ["index"], size=None, indexes=catalog._indexes(store, where, view, up_to))
            assert [tuple(r) for r in found.rows.collect()] == [tuple(r) for r in plain.rows.collect()]
            assert found.total == plain.total > 0


def test_an_interrupted_rewriting_changes_nothing(spark, made, monkeypatch):
    catalog, source, folder = made
    catalog.create_table("t", FIELDS, source, start=False)
    drain(catalog)
    arrive(spark, folder, [record(i) for i in range(20, 30)])
    drain(catalog)
    store = catalog.store("t")

    def die(self, new):
        raise _Interrupted

    with monkeypatch.context() as patched:
        patched.setattr("tarnseek.streaming.ranges.Ranges.note", die)
        with pytest.raises(_Interrupted):
            catalog.compact("t", batches=1)
    assert keys(store.rows()) == list(range(30))
    arrive(spark, folder, [record(i) for i in range(30, 35)])
    drain(catalog)
    assert catalog.compact("t", batches=1) == 2 and catalog.compact("t", batches=1) == 2
    assert keys(store.rows()) == list(range(35)) and keys(store.rows(up_to=0)) == list(range(20))
    assert store.folder.child("data").names() == []
    arrive(spark, folder, [record(35)])
    drain(catalog)
    assert keys(store.rows()) == list(range(36))
