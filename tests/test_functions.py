from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarnseek.errors import TarnseekError
from tarnseek.functions import dates, globs, jsonvals
from tarnseek.schema import Field
from tarnseek.sources.decode import typed
from tarnseek.functions.analyzers import (
    CASE_PRESERVING,
    STANDARD,
    Analyzer,
    analyzer_named,
    register_analyzer,
    reset_analyzers,
    stop_words_from_lines,
)

MICROS = "uuuu-MM-dd'T'HH:mm:ss.SSSSSS"


def tokens(spark, analyzer, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(analyzer.tokens(F.col("t")).alias("w")).first()["w"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("user:admin", ["user:admin"]),
        ("zhang张三", ["zhang", "张", "三"]),
        ("Fea后台", ["fea", "后", "台"]),
        ("The cat of 3.14, 1,000 don't", ["cat", "3.14", "1,000", "don't"]),
        ("a1.b foo_bar _x_ ___ x-y", ["a1", "b", "foo_bar", "_x_", "x", "y"]),
        ("カタカナとひら ไทย abc", ["カタカナ", "と", "ひ", "ら", "ไทย", "abc"]),
        ("été ÉTÉ éa", ["été", "été", "éa"]),
        ("...", []),
        ("", []),
    ],
)
def test_standard_tokens(spark, text, expected):
    assert tokens(spark, STANDARD, text) == expected


def test_case_preserving_keeps_case_and_capital_stop_words(spark):
    assert tokens(spark, CASE_PRESERVING, "The cat of The Cat") == ["The", "cat", "The", "Cat"]


def test_long_words_are_chopped(spark):
    assert [len(t) for t in tokens(spark, STANDARD, "x" * 600 + " y")] == [255, 255, 90, 1]


def test_stop_words_leave_gaps(spark):
    assert STANDARD.analyze_literal(spark, "From the Land") == [(0, "from"), (2, "land")]


def test_custom_stop_words(spark):
    words = stop_words_from_lines(["cat\n", "", " dog "])
    assert tokens(spark, STANDARD.with_stop_words(words), "the cat the dog") == ["the", "the"]


def test_registry_is_case_insensitive_and_reloadable():
    try:
        register_analyzer("Mine", Analyzer("mine", lowercase=False, stop_words=()))
        assert analyzer_named("mINE").lowercase is False
        reset_analyzers()
        with pytest.raises(TarnseekError):
            analyzer_named("mine")
    finally:
        reset_analyzers()


def test_analyzer_survives_json():
    made = STANDARD.with_stop_words(["x"])
    assert Analyzer.from_dict(made.to_dict()) == made


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("a?b", ["axb", "a_b", "a张b"], ["ab", "axxb", "xaxb"]),
        ("a*b", ["ab", "axxb", "a\nb"], ["abc", "a"]),
        ("ab*", ["ab", "abc"], ["xab", "Ab"]),
        ("*ab", ["ab", "xab"], ["abx"]),
        ("*ab*", ["ab", "xabx"], ["a b"]),
        ("a\\*b", ["a*b"], ["axb"]),
        ("a\\", ["a\\"], ["a"]),
        ("5%_", ["5%_"], ["5xx", "5%x"]),
        ("5%_*", ["5%_", "5%_z"], ["5xx"]),
        ("a\\?*", ["a?", "a?b"], ["ab"]),
        ("*", ["", "x"], [None]),
        ("", [""], ["x"]),
    ],
)
def test_glob(spark, glob, yes, no):
    df = spark.createDataFrame([(v,) for v in [*yes, *no]], "v string")
    found = [r["m"] for r in df.select(globs.glob_match(F.col("v"), glob).alias("m")).collect()]
    assert found == [True] * len(yes) + [None if v is None and glob != "*" else False for v in no]


def test_glob_literal_runs():
    assert globs.literal_runs("ab*c\\*d?e") == ["ab", "c*d", "e"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates_keep_fractions_and_order_in_any_zone(spark, zone):
    texts = [
        "2019-02-23T23:51:12.872516",
        "2019-02-23T23:51:12.012000",
        "2019-02-23T23:51:12.120000",
        "1965-02-23T00:00:00.000001",
        "2019-03-10T02:30:00.000000",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ts = dates.parse_date(F.col("t"), MICROS)
        nanos = dates.to_nanos(ts)
        rows = df.select(ts.alias("ts"), nanos.alias("n"), dates.from_nanos(nanos).alias("back")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    expected = [datetime.fromisoformat(t) for t in texts]
    assert [r["ts"] for r in rows] == expected == [r["back"] for r in rows]
    assert sorted(rows, key=lambda r: r["n"]) == sorted(rows, key=lambda r: r["ts"])
    assert rows[0]["n"] == 1550965872872516000


def test_bad_dates_are_null(spark):
    df = spark.createDataFrame([("2019-02-30T00:00:00.000000",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(dates.parse_date(F.col("t"), MICROS)).collect()] == [None] * 3


@pytest.mark.parametrize(
    "value, pattern, expected",
    [
        ("2019-02-28T09:43:10.224000", MICROS, datetime(2019, 2, 28, 9, 43, 10, 224000)),
        ("2019-02-18 15:45:54.607", "yyyy-MM-dd HH:mm:ss.SSS", datetime(2019, 2, 18, 15, 45, 54, 607000)),
        ("1998-10-03", "yyyy-MM-dd", datetime(1998, 10, 3)),
        ("3/11/1998", "d/M/yyyy", datetime(1998, 11, 3)),
        ("03 Nov 1998", "dd MMM yyyy", datetime(1998, 11, 3)),
        ("1998-11-03 04:05 PM", "yyyy-MM-dd hh:mm a", datetime(1998, 11, 3, 16, 5)),
        ("98-11-03", "yy-MM-dd", datetime(2098, 11, 3)),
        (1550965872872516000, MICROS, datetime(2019, 2, 23, 23, 51, 12, 872516)),
        (datetime(2020, 1, 1), None, datetime(2020, 1, 1)),
    ],
)
def test_date_literal(spark, value, pattern, expected):
    assert dates.date_literal(value, pattern) == expected


@pytest.mark.parametrize("value", ["2019-02-28", "2019-02-31T00:00:00.000000", 1.5, None])
def test_bad_date_literal(spark, value):
    with pytest.raises(TarnseekError):
        dates.date_literal(value, MICROS)


def test_typed_fields(spark):
    cases = [("7", 7, 7), ("-7", -7, -7), ("3000000000", None, 3000000000), ("7.0", None, None), ("1e2", None, None),
             ("x", None, None), ("", None, None), (None, None, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    small, big = Field("a", "int"), Field("a", "long")
    got = df.select("t", typed(F.col("t"), small).alias("i"), typed(F.col("t"), big).alias("l")).collect()
    assert [tuple(r) for r in got] == cases


def test_json_kinds(spark):
    cases = {
        '{"a":1}': "int",
        '{"a":-2147483649}': "long",
        '{"a":99999999999999999999}': "double",
        '{"a":1.0}': "double",
        '{"a":"1"}': "string",
        '{"a":true}': "boolean",
        '{"a":null}': "null",
        '{"a":[1,"x"]}': "array",
        '{"a":{"b":1}}': "object",
        '{"b":1}': None,
        '{"a"': None,
    }
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    found = {r["v"]: r["k"] for r in df.select("v", jsonvals.value_kind(F.col("v"), "$.a").alias("k")).collect()}
    assert found == cases


def test_lenient_json_and_missing_text(spark):
    cases = {"{'a':2,b:3}": "2", '{"a":null}': None, '{"b":1}': "null", '{"a":{"c":[1]}}': '{"c":[1]}'}
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    read = jsonvals.member_or_null_text(jsonvals.decode_object(F.col("v")), "a")
    assert {r["v"]: r["a"] for r in df.select("v", read.alias("a")).collect()} == cases
