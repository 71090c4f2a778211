import random
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F


from tarnseek import (
    Between,
    Compare,
    Equals,
    Field,
    HasField,
    Kind,
    Like,
    MatchAll,
    MatchAny,
    Phrase,
    TableSpec,
    TableView,
    TarnseekError,
    search_view,
)
from tests.compare import TESTDATA
from tarnseek.operators import ordering
from tarnseek.operators.clauses import matching
from tarnseek.operators.grouping import count_name, group_heads, group_members, ordered_groups
from tarnseek.operators.indexed import StoredPostings
from tarnseek.operators.lookup import fetch_records, latest_records
from tarnseek.operators.score_bounds import Bounds, bounded
from tarnseek.operators import sorted_postings as stretches
from tarnseek.operators.postings import PostingsTable, TermDictionary, build_postings, rows_with_all, term_stats
from tarnseek.operators.relevance import rounded_length
from tarnseek.operators.sorted_postings import sorted_postings

FIELDS = (
    Field("id", Kind.INT),
    Field("big", Kind.LONG),
    Field("city", Kind.STRING),
    Field("note", Kind.TEXT),
    Field("at", Kind.DATE, "yyyy-MM-dd"),
    Field("price", Kind.DOUBLE),
)
SPEC = TableSpec("t", FIELDS)
ROWS = [
    (1, 10, "hz", "The red cat sat on the mat", datetime(2019, 1, 1), 1.5),
    (2, 20, "bj", "a cat and a dog", datetime(2019, 1, 2), 2.5),
    (3, None, None, "mat the cat", None, None),
    (4, -5, "hz", None, datetime(1999, 5, 5), -1.0),
    (5, 0, "sh", "dog dog dog", datetime(2019, 1, 2), 5.3),
]


@pytest.fixture(scope="module")
def view(spark):
    df = spark.createDataFrame(ROWS, "id int, big long, city string, note string, at timestamp_ntz, price double")
    return TableView(df, SPEC, ("id",))


def ids(view, where):
    return sorted(r["id"] for r in matching(view, where).df.collect())


@pytest.mark.parametrize(
    "where, expected",
    [
        (None, [1, 2, 3, 4, 5]),
        (Equals("id", 2), [2]),
        (Equals("city", "hz"), [1, 4]),
        (Equals("city", "HZ"), []),
        (Equals("note", "cat"), [1, 2, 3]),
        (Equals("note", "Cat"), []),
        (Equals("note", "the"), []),
        (Equals("at", "2019-01-02"), [2, 5]),
        (Compare("big", ">", 0), [1, 2]),
        (Compare("big", "<=", 0), [4, 5]),
        (Compare("id", ">", 2.5), [3, 4, 5]),
        (Compare("price", "<=", 5.3), [1, 2, 4, 5]),
        (Compare("at", "<", "2019-01-02"), [1, 4]),
        (Between("id", 2, 4), [2, 3, 4]),
        (Between("at", "2019-01-01", "2019-01-02"), [1, 2, 5]),
        (Like("city", "?z"), [1, 4]),
        (Like("city", "*"), [1, 2, 4, 5]),
        (Like("note", "?at"), [1, 2, 3]),
        (Like("note", "d*"), [2, 5]),
        (Like("note", "cat*sat"), []),
        (HasField("note"), [1, 2, 3, 5]),
        (MatchAll("note", "the CAT mat"), [1, 3]),
        (MatchAny("note", "Red or DOG"), [1, 2, 5]),
        (MatchAny("note", "the of"), []),
        (Phrase("note", "red cat"), [1]),
        (Phrase("note", "mat the cat"), [3]),
        (Phrase("note", "mat cat"), []),
        (Phrase("note", "cat sat the mat"), []),
        (Phrase("note", "sat on a mat"), [1]),
        (Phrase("note", "dog dog"), [5]),
        (Equals("city", "hz") & Equals("note", "cat") | Equals("id", 5), [1, 5]),
        (Equals("city", "hz") & (Equals("note", "cat") | Compare("big", "<", 0)), [1, 4]),
        (
            (Equals("city", "hz") & Like("note", "c?t"))
            | (Compare("big", ">", 11) | Between("id", 1, 4)) & Compare("price", "<=", 5.3),
            [1, 2, 4],
        ),
    ],
)
def test_filters(view, where, expected):
    assert ids(view, where) == expected
    assert ids(view.with_tokens("note"), where) == expected


@pytest.mark.parametrize(
    "where",
    [
        Equals("nope", 1),
        Equals("id", "1"),
        Equals("city", 1),
        Equals("note", 5),
        Compare("city", ">", "a"),
        Compare("note", ">", 1),
        Compare("id", ">", True),
        Compare("id", "!=", 1),
        Compare("big", ">", 2**63),
        Compare("at", ">", "not a date"),
        Between("id", 5, 4),
        Between("at", "2019-01-02", "2019-01-01"),
        Like("id", "1*"),
        Phrase("city", "x"),
    ],
)
def test_wrong_filters(view, where):
    with pytest.raises(TarnseekError):
        where.condition(view.with_tokens("note"))


# --- orders and pages -------------------------------------------------------------
def test_missing_values_in_sorts(view):
    def order(*by):
        return [r["id"] for r in search_view(view, None, ["id"], by).rows.collect()]

    assert order("big") == [4, 3, 5, 1, 2]
    assert order("big desc") == [2, 1, 3, 5, 4]
    assert order("city") == [3, 2, 1, 4, 5]
    assert order("city desc", "id desc") == [5, 4, 1, 2, 3]
    assert order("at") == [3, 4, 1, 2, 5]
    assert order(("price", "desc")) == [5, 2, 1, 3, 4]


@pytest.mark.parametrize("by", ["note", "nope", "id up"])
def test_wrong_orders(view, by):
    with pytest.raises(TarnseekError):
        search_view(view, None, ["id"], [by])


@pytest.mark.parametrize(
    "page, size, start, count",
    [(1, 102, 0, 102), (10, 102, 918, 82), (2, 15, 15, 15), (75, 15, 1110, 0), (101, 10, 1000, 0), (1, 2000, 0, 1000)],
)
def test_pages(spark, page, size, start, count):
    spec = TableSpec("n", (Field("id", Kind.LONG),))
    rows = search_view(TableView(spark.range(1000), spec, ("id",)), page=page, size=size, order_by=["id"]).rows
    assert [r["id"] for r in rows.collect()] == list(range(start, start + count))


@pytest.mark.parametrize("page, size", [(0, 5), (1, 0), (-1, 5), (1.0, 5), (True, 5)])
def test_wrong_pages(view, page, size):
    with pytest.raises(TarnseekError):
        search_view(view, page=page, size=size)


def many_rows(n=3000, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # A third of all rows share one city and price; some values are missing.
        hot = i % 3 == 0
        city = "hot" if hot else rng.choice([None, "a", "b", "c"])
        price = 1.0 if hot else rng.choice([None, 0.0, rng.random() * 10])
        at = None if i % 11 == 0 else datetime(2020, 1, 1 + i % 28)
        rows.append((i, city, price, at))
    return rows


@pytest.mark.parametrize("order, size", [(["city desc", "price"], 40), (["price desc"], 400), (["at", "city"], 7)])
def test_deep_pages_match_plain_sorting(spark, monkeypatch, order, size):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 50)
    monkeypatch.setattr(ordering, "_SPLITS", 3)
    rows = many_rows()
    df = spark.createDataFrame(rows, "id int, city string, price double, at timestamp_ntz").repartition(4)
    fields = (Field("id", Kind.INT), Field("city", Kind.STRING), Field("price", Kind.DOUBLE), Field("at", Kind.DATE))
    deep = TableView(df, TableSpec("d", fields), ("id",))
    keys = ordering.sort_keys(deep, order)
    expected = [r["id"] for r in ordering.ordered(df, keys).collect()]
    last = len(rows) // size + 1
    for page in (last // 2, last - 1, last, last + 1):
        got = [r["id"] for r in ordering.page_rows(df, keys, page, size, counted_ranges=True).collect()]
        assert got == expected[(page - 1) * size : page * size], (order, size, page)


def test_deep_pages_over_equal_rows(spark, monkeypatch):
    """Rows that no key tells apart still fill each page with the right number."""
    monkeypatch.setattr(ordering, "RANGE_ROWS", 50)
    df = spark.range(1000).selectExpr("id div 400 as k")
    keys = [ordering.SortKey(F.col("k"))]
    for size in (90, 200):
        pages = -(-1000 // size)
        got = [r["k"] for p in range(1, pages + 1) for r in ordering.page_rows(df, keys, p, size, counted_ranges=True).collect()]
        assert got == [0] * 400 + [1] * 400 + [2] * 200


def test_counted_ranges_over_strings_with_one_beginning(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 20)
    df = spark.range(3000).selectExpr("concat('http://same.example/', id * 7919 % 3000, case when id % 2 = 0 then '/é' else '' end) as k")
    keys = [ordering.SortKey(F.col("k"))]
    expected = [r["k"] for r in df.orderBy("k").collect()]
    for page in (1, 17, 60):
        got = [r["k"] for r in ordering.page_rows(df, keys, page, 50, counted_ranges=True).collect()]
        assert got == expected[(page - 1) * 50 : page * 50]


def test_cursors_are_pushed_to_the_scan(spark):
    lines = spark.read.parquet(f"{TESTDATA}/sf0.001/lineitem.parquet")
    keys = [ordering.SortKey(F.col("l_quantity"), True, 0), ordering.SortKey(F.col("l_orderkey"))]
    plan = ordering.page_after(lines, keys, [40.0, 100], 10)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters: [") :].split("]")[0]
    assert "LessThan(l_quantity,40.0)" in pushed


def test_cursor_walks_all_rows(spark):
    rows = many_rows(500)
    df = spark.createDataFrame(rows, "id int, city string, price double, at timestamp_ntz")
    fields = (Field("id", Kind.INT), Field("city", Kind.STRING), Field("price", Kind.DOUBLE), Field("at", Kind.DATE))
    walked = TableView(df, TableSpec("d", fields), ("id",))
    keys = ordering.sort_keys(walked, ["city desc", "at"])
    named = df.select("*", *[k.column.alias(f"k{i}") for i, k in enumerate(keys)])
    got, batch = [], ordering.top(named, keys, 60).collect()
    while batch:
        got += [r["id"] for r in batch]
        last = tuple(batch[-1][f"k{i}"] for i in range(len(keys)))
        batch = ordering.page_after(named, keys, last, 60).collect()
    assert got == [r["id"] for r in ordering.ordered(df, keys).collect()]


# --- search ------------------------------------------------------------------------
def test_total_and_projection(view):
    found = search_view(view, Equals("note", "cat"), ["city", "id", "city"], ["id desc"], size=2)
    assert found.total == 3
    assert found.rows.columns == ["city", "id"]
    assert [r["id"] for r in found.rows.collect()] == [3, 2]


def test_star_is_all_declared_columns(view):
    assert search_view(view.with_tokens("note")).rows.columns == SPEC.field_names


def test_undeclared_columns_need_json(view):
    with pytest.raises(TarnseekError):
        search_view(view, select=["other"])


def test_rank_by_relevance(view):
    found = search_view(view, MatchAny("note", "dog cat"), ["id"])
    assert [r["id"] for r in found.rows.collect()] == [2, 5, 3, 1]
    assert found.total == 4


def test_or_of_plain_clauses_ranks_by_matches(view):
    where = Equals("id", 5) | Compare("id", ">", 3) | Compare("id", ">=", 1)
    assert [r["id"] for r in search_view(view, where, ["id"]).rows.collect()] == [5, 4, 1, 2, 3]


def test_envelope(view):
    text = search_view(view, Equals("id", 2), ["id", "city", "at"], ["id"]).envelope()
    assert text == (
        '{"total": 1, "results": [{"id": 2, "city": "bj", "at": "2019-01-02T00:00:00.000000"}], "success": true}'
    )


def test_whole_answers_are_written(view, tmp_path):
    """Without a size nothing whole passes through the driver."""
    whole = search_view(view, Compare("id", ">", 0), ["id"], ["id desc"], size=None, snapshot=7)
    groups = search_view(view, group_by="city")
    for found, name in ((whole, "whole"), (groups, "groups")):
        with pytest.raises(TarnseekError, match="write_answer"):
            found.envelope()
        found.write_answer(f"{tmp_path}/{name}")
    lines = [x for f in sorted((tmp_path / "whole" / "results").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == [f'{{"id":{i}}}' for i in (5, 4, 3, 2, 1)]
    total = [x for f in (tmp_path / "whole" / "total").glob("part-*") for x in f.read_text().splitlines()]
    assert total == ['{"total":5,"success":true,"key":7}']
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "groups" / "results").glob("part-*")) == 4


# --- groups ------------------------------------------------------------------------
def test_count_name():
    assert count_name([]) == "count"
    assert count_name(["count", "_count"]) == "__count"


def test_groups(view):
    rows = ordered_groups(view, "city", ["id", "city desc"]).collect()
    assert [(r["city"], r["count"]) for r in rows] == [("sh", 1), ("hz", 2), ("bj", 1), (None, 1)]
    found = search_view(view, group_by="city")
    assert found.total == 4
    assert [r["city"] for r in found.rows.collect()] == ["hz", "bj", None, "sh"]


def test_groups_by_relevance(view):
    where = MatchAny("note", "dog cat")
    for order in ([], ["id desc"]):
        rows = search_view(view, where, group_by="city", order_by=order).rows.collect()
        assert [tuple(r) for r in rows] == [("bj", 1), ("sh", 1), (None, 1), ("hz", 1)]
    rows = search_view(view, where, group_by="city", order_by=["city"]).rows.collect()
    assert [r["city"] for r in rows] == [None, "bj", "hz", "sh"]


def test_group_heads_and_members(view):
    heads = {r["city"]: r["id"] for r in group_heads(view, "city", ["id desc"]).collect()}
    assert heads == {"hz": 4, "bj": 2, "sh": 5, None: 3}
    order = ["city desc", "id desc"]
    members = [r["id"] for p in (1, 2, 3) for r in group_members(view, "city", order, page=p, size=2).collect()]
    assert members == [5, 4, 1, 2, 3]


def test_empty_groups(view):
    found = search_view(view, Equals("id", 99), group_by="city")
    assert found.total == 0 and found.rows.collect() == []


@pytest.mark.parametrize("group", ["note", "nope", ["id", "city"]])
def test_wrong_groups(view, group):
    with pytest.raises(TarnseekError):
        search_view(view, group_by=group)


# --- postings ------------------------------------------------------------------------
def test_postings_match_brute_force(view):
    got = {(r["id"], r["term"]): (r["tf"], r["length"], r["positions"]) for r in build_postings(view, "note").collect()}
    stop = set(SPEC.analyzer.stop_words)
    expected = {}
    for row in ROWS:
        words = (row[3] or "").lower().split()
        kept = [w for w in words if w not in stop]
        for w in kept:
            places = [i for i, x in enumerate(words) if x == w]
            expected[row[0], w] = (len(places), len(kept), places)
    assert got == expected


def test_hot_buckets_are_split(spark, tmp_path):
    hot = spark.range(400_000).select("id", F.md5(F.col("id").cast("string")).alias("positions"), F.lit("hot").alias("term"))
    files = {}
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
        try:
            PostingsTable(f"{tmp_path}/{adaptive}", buckets=8, salts=4).write(hot, ["id"])
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        files[adaptive] = len(list(tmp_path.glob(f"{adaptive}/_bucket=*/*.parquet")))
    assert files["true"] > 1 and files["false"] > 1, files


@pytest.mark.parametrize("at_once", [1 << 20, 7])
def test_postings_to_be_written_come_in_sorted_stretches(spark, monkeypatch, at_once):
    """The same as those of each row by itself, also with empty slots, rows without any, and rows alike; each stretch by term."""
    monkeypatch.setattr(stretches, "TOKENS_AT_ONCE", at_once)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "red", "cat", "école", "mat", "zz"]) for _ in range(rng.randrange(9))) for _ in range(60)]
    rows = [(i % 50 if i % 7 else None, t if i % 5 else None) for i, t in enumerate(texts)]
    notes = TableView(spark.createDataFrame(rows, "id int, note string"), TableSpec("t", (Field("id", Kind.INT), Field("note", Kind.TEXT))), ("id",))
    for positions in (True, False):
        found, plain = sorted_postings(notes, "note", positions), build_postings(notes, "note", positions)
        assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [(f.name, f.dataType.simpleString()) for f in plain.schema]
        assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    terms = [r["term"] for r in sorted_postings(replace(notes, df=notes.df.coalesce(1)), "note").collect()]
    falls = sum(a > b for a, b in zip(terms, terms[1:]))
    assert falls == 0 if at_once > 100 else 0 < falls < len(terms) / 2


def test_dictionary_has_each_trigram_of_a_term_once_and_in_order(spark, tmp_path):
    terms = ["aaaaaa", "ababab", "x", "ée", "日本", "\U0001f600\U0001f600", "power", "poker"]
    dictionary = TermDictionary(f"{tmp_path}/dictionary", buckets=4)
    dictionary.write(spark.createDataFrame([(t, 1) for t in terms * 2], "term string, _bucket int"), "_upto=1")
    rows = spark.read.parquet(f"{tmp_path}/dictionary/_upto=1").collect()
    edged = {t: f"\x02{t}\x03" for t in terms}
    wanted = {(t, w[i : i + 3]) for t, w in edged.items() for i in range(len(w) - 2)}
    assert sorted((r["term"], r["gram"]) for r in rows) == sorted(wanted) and {r["rows"] for r in rows} == {2}
    assert sorted((r["term"], r["gram"]) for r in rows if r["first"]) == sorted((t, w[:3]) for t, w in edged.items())
    for file in {f for b in range(4) for f in (tmp_path / f"dictionary/_upto=1/_grams={b}").glob("*.parquet")}:
        grams = [r["gram"] for r in spark.read.parquet(str(file)).collect()]
        assert grams == sorted(grams)
    assert {r["term"] for r in dictionary.like(spark, "po*er").collect()} == {"power", "poker"}
    assert {r["term"] for r in dictionary.like(spark, "*").collect()} == set(terms)


def test_postings_table_reads_only_its_buckets(spark, view, tmp_path):
    table = PostingsTable(f"{tmp_path}/postings", buckets=16, salts=2)
    table.write(build_postings(view, "note"), ["id"])
    found = table.read(spark, ["cat", "dog"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [((_bucket" in plan
    assert {r["id"] for r in rows_with_all(found, ["id"], ["cat", "dog"]).collect()} == {2}
    whole = {r["term"]: (r["doc_freq"], r["total_freq"]) for r in term_stats(table.read(spark)).collect()}
    assert whole["dog"] == (2, 4) and whole["cat"] == (3, 3)


def test_rounded_lengths(spark):
    def expected(n):
        if n < 24:
            return n
        rest = n - 24
        shift = max(rest.bit_length() - 4, 0)
        return 24 + (rest >> shift << shift)

    df = spark.range(5000)
    got = df.select("id", rounded_length(F.col("id")).alias("n")).collect()
    assert all(r["n"] == expected(r["id"]) for r in got)


# --- lookup ------------------------------------------------------------------------
def test_lookup_leaves_out_lost_records(spark):
    hits = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "_name string, _key string")
    records = spark.createDataFrame(
        [("a", "1", "old", 1), ("a", "1", "new", 2), ("b", "1", "x", 1)], "_name string, _key string, value string, v int"
    )
    current = latest_records(records, ["_name", "_key"], "v")
    found = fetch_records(hits, current, ["_name", "_key"])
    assert sorted((r["_name"], r["value"]) for r in found.collect()) == [("a", "new"), ("b", "x")]
    assert "Broadcast" in found._jdf.queryExecution().executedPlan().toString()


def test_latest_of_nulls_and_of_a_replayed_log(spark):
    rows = [("a", "1", "x", 2, {}), ("a", "1", "w", 2, {}), ("a", "1", "x", 2, {}), ("a", "1", "old", 1, {}), ("a", None, "null", 3, {}), ("a", None, "older", None, {})]
    rows += [("b", "1", "no version", None, {}), ("b", "1", "no version", None, {}), (None, None, "none", 1, {})]
    records = spark.createDataFrame(rows, "_name string, _key string, value string, v int, m map<string, string>")
    for again in (records, records.repartition(7)):
        got = latest_records(again, ["_name", "_key"], "v").select("_name", "_key", "value", "v").collect()
        assert sorted(map(tuple, got), key=str) == sorted([("a", "1", "w", 2), ("a", None, "null", 3), ("b", "1", "no version", None), (None, None, "none", 1)], key=str)


# --- one pass over the table ---------------------------------------------------------------------
@pytest.mark.parametrize(
    "where",
    [
        Equals("note", "cat"),
        MatchAny("note", "Red or DOG"),
        MatchAll("note", "the CAT mat"),
        Phrase("note", "cat sat on the mat") | Phrase("note", "nowhere to be seen"),
        Like("note", "?at") | Equals("note", "dog"),
        Equals("city", "hz") & Equals("note", "cat") | Equals("id", 5) | Equals("city", "bj"),
        Compare("big", ">", 0),
        Equals("note", "nothing"),
    ],
)
@pytest.mark.parametrize("order_by", [(), ("id desc",)])
def test_a_single_pass_gives_the_same(view, where, order_by):
    asked = dict(select=["id", "note", "city"], order_by=order_by, size=10)
    usual = search_view(view, where, **asked)
    found = search_view(view, where, single_pass=True, **asked)
    assert [tuple(r) for r in found.rows.collect()] == [tuple(r) for r in usual.rows.collect()]
    assert found.total == usual.total
    narrow = search_view(view, where, select=["id"], order_by=order_by, single_pass=True, rounded_lengths=True)
    assert [r["id"] for r in narrow.rows.collect()] == [r["id"] for r in search_view(view, where, select=["id"], order_by=order_by, rounded_lengths=True).rows.collect()]
    grouped = search_view(view, where, group_by="city", single_pass=True)
    assert [tuple(r) for r in grouped.rows.collect()] == [tuple(r) for r in search_view(view, where, group_by="city").rows.collect()]


def test_a_single_pass_reads_the_table_once(view, tmp_path):
    """The answer's plan reads the written hits, not the table; texts that weren't asked for aren't written."""
    path = f"{tmp_path}/table"
    view.df.write.parquet(path)
    spark = view.df.sparkSession
    stored = replace(view, df=spark.read.parquet(path))
    found = search_view(stored, MatchAny("note", "cat dog"), select=["id"], single_pass=True)
    plan = found.rows._jdf.queryExecution().executedPlan().toString() + found.counted._jdf.queryExecution().executedPlan().toString()
    assert path not in plan and "regexp_extract_all" not in plan and "note" not in plan.replace("_x", "")


def test_texts_are_dealt_over_as_many_tasks_as_the_session_says(spark, view):
    spark.conf.set("spark.tarnseek.textSplits", "3")
    try:
        tokenised = view.with_tokens("note")
        assert tokenised.df.rdd.getNumPartitions() == 3
        assert search_view(view, Equals("note", "cat")).total == 3
    finally:
        spark.conf.unset("spark.tarnseek.textSplits")


# --- group members by offsets ----------------------------------------------------------------------
@pytest.mark.parametrize("order_by", [(), ("g desc", "v"), ("v desc",), ("s", "g")])
def test_members_by_offsets(spark, monkeypatch, order_by):
    """Every page, groups of one to many rows, missing groups and a real zero among them."""
    monkeypatch.setattr(ordering, "RANGE_ROWS", 7)
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 0, 0, 3, *range(-40, 40)]) if i % 3 else 11, rng.randrange(9), rng.choice("abc")) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g int, v int, s string")
    members = TableView(df, TableSpec("m", (Field("id", Kind.INT), Field("g", Kind.INT), Field("v", Kind.INT), Field("s", Kind.STRING))), ("id",))
    asked = dict(group_by="g", order_by=order_by, size=70)
    for page in (1, 2, 5, 6):
        usual = group_members(members, page=page, by_offsets=False, **asked).collect()
        assert group_members(members, page=page, by_offsets=True, **asked).collect() == usual
    with pytest.raises(TarnseekError):
        group_members(members, "g", page=0, by_offsets=True)


def test_members_by_offsets_read_the_groups_of_the_page(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE_ROWS", 100)
    df = spark.range(5000).selectExpr("cast(id as int) id", "cast(id div 10 as int) g")
    df.write.parquet(f"{tmp_path}/rows")
    members = TableView(spark.read.parquet(f"{tmp_path}/rows"), TableSpec("m", (Field("id", Kind.INT), Field("g", Kind.INT))), ("id",))
    page = group_members(members, "g", page=100, size=20, by_offsets=True)
    assert [r["id"] for r in page.collect()] == list(range(1980, 2000))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan" in plan.split("PushedFilters:")[1].split("]")[0] or "Or(" in plan.split("PushedFilters:")[1].split("]")[0]


# --- pages by score bounds ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def ranked_texts(spark, tmp_path_factory):
    """3,000 texts: a word in nearly all, one in a third, rare ones, ties, nulls and empty texts."""
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        words = ["common"] * rng.randrange(4) + ["third"] * (rng.random() < 0.33) * rng.randrange(1, 3)
        words += ["rare"] * (i % 60 == 0) * rng.randrange(1, 5) + ["scarce"] * (i % 100 == 7) + ["filler"] * rng.choice([0, 3, 3, 40])
        rng.shuffle(words)
        rows.append((i, None if i % 500 == 3 else " ".join(words)))
    df = spark.createDataFrame(rows, "id int, note string").repartition(5)
    texts = TableView(df, TableSpec("r", (Field("id", Kind.INT), Field("note", Kind.TEXT))), ("id",))
    return texts, {"note": StoredPostings(texts, "note", f"{tmp_path_factory.mktemp('postings')}/index", buckets=4)}


@pytest.mark.parametrize(
    "where, rounded",
    [
        (MatchAny("note", "rare common"), True),
        (MatchAny("note", "common third rare scarce rare nowhere"), False),
        (MatchAny("note", "rare third") | Equals("note", "common") | MatchAny("note", "third"), False),
        (MatchAny("note", "nowhere"), False),
        (MatchAny("note", "rare common") & Compare("id", ">", 1000), False),
    ],
)
def test_a_page_by_bounds_is_that_of_the_full_ranking(ranked_texts, where, rounded):
    texts, index = ranked_texts
    for page, size in ((3, 10), (1, 200)):
        asked = dict(select=["id"], page=page, size=size, indexes=index, rounded_lengths=rounded)
        usual, found = search_view(texts, where, **asked), search_view(texts, where, score_bounds=True, **asked)
        assert found.rows.collect() == usual.rows.collect()
    assert found.total == usual.total


def test_bounds_leave_out_what_cannot_reach_the_page(ranked_texts):
    texts, index = ranked_texts
    where = MatchAny("note", "rare common")
    sources, _ = bounded(texts, where, index, 10)
    hits = search_view(texts, where, indexes=index).total
    left = sources["note"].postings(["rare", "common"]).select("id").distinct().count()
    assert hits > 2000 and 10 <= left <= 50
    # A page longer than any one term's postings tells nothing.
    assert bounded(texts, where, index, 5000)[0] == index
    assert bounded(texts, MatchAll("note", "rare common"), index, 10) is None
    assert bounded(texts, Equals("note", "rare") | Equals("id", 3), index, 10) is None


def test_bounds_by_hand():
    found = Bounds({"a": 5.0, "b": 1.0, "c": 0.5}, 3.0)
    assert found.searched() == ["a"] and found.least("a") == 1.5 and found.prune()
    assert Bounds({"a": 5.0, "b": 2.6, "c": 0.5}, 3.0).searched() == ["a", "b"]
    assert not Bounds({"a": 5.0, "b": 5.0}, 0.0).prune() and not Bounds({"a": 0.0}, 0.0).prune()


def test_pages_far_in_are_counted_unasked(spark, monkeypatch, tmp_path):
    """A page that ends after ``RANGE_ROWS`` rows reads only the ranges it lies in; earlier ones are a top-k."""
    monkeypatch.setattr(ordering, "RANGE_ROWS", 100)
    spark.range(3000).selectExpr("cast(id as int) id", "cast(id div 20 as int) g").write.parquet(f"{tmp_path}/rows")
    rows = TableView(spark.read.parquet(f"{tmp_path}/rows"), TableSpec("m", (Field("id", Kind.INT), Field("g", Kind.INT))), ("id",))

    def filters(df):
        return df._jdf.queryExecution().executedPlan().toString().split("PushedFilters:")[1].split("]")[0]

    for page in (lambda p: search_view(rows, None, ["id"], order_by=["id"], page=p, size=20).rows, lambda p: group_members(rows, "g", page=p, size=20)):
        for p in (1, 5, 6, 90, 151):
            assert [r["id"] for r in page(p).collect()] == list(range(20 * p - 20, 20 * p))[: 0 if p > 150 else 20]
        assert "Than" not in filters(page(5)) and "Than" in filters(page(90))
