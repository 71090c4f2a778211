import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnseek.llm import quality
from tarnseek.llm.registered import QUERIES
from tests.compare import TESTDATA
from tests.llm.helpers import awkward, docs_of, empty, rows_of

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def slow_signs(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def slow_base_failed(s):
    return s[0] < 50 or 100 * s[4] > 50 * s[0]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_counting_by_hand(spark, sf):
    got = QUERIES["op1_quality_rules"](spark, f"{TESTDATA}/{sf}")
    docs = spark.read.parquet(f"{TESTDATA}/{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = Counter((d, *slow_signs(t), slow_base_failed(slow_signs(t))) for d, t in docs)
    assert rows_of(got.select("doc_id", *BASE, "base_failed")) == expected
    assert got.where("base_failed and kept").count() == 0
    assert dict(got.dtypes)["kept"] == "boolean" and dict(got.dtypes)["n_words"] == "bigint"


def test_verdict_tells_good_from_bad(spark):
    sf = f"{TESTDATA}/sf0.01"
    rows = QUERIES["op1_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    found = {(r["quality"], r["kept"]): r["count"] for r in rows.where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert found.get((1, False), 0) == 0 and found.get((0, True), 0) == 0 and found[0, False] > 10


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b c d", "x y", "", "a b c x a b c y a b c", "a b a b a b a", " a\tb\nc\x0ba b\rc "])
def test_repeated_words(spark, text):
    assert docs_of(spark, [text]).select(quality.signs(F.col("text"))["n_repeat_words"]).first()[0] == slow_signs(text)[4]


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = df.select(*[quality.signs(F.col("text"))[c].alias(c) for c in BASE], F.col("text").alias("t")).collect()
    assert [tuple(r)[:5] for r in rows] == [slow_signs(r["t"]) for r in rows]
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.assess(df, labels).count() == df.count()
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    assert kept.count() == 0 or set(r["text"] for r in kept.collect()) <= set(r["text"] for r in df.collect())


def test_no_rows_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.assess(empty(spark), labels).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    assert quality.keep_good(docs_of(spark, [text, None]), labels).count() == 1


def labelled(spark, rows):
    names = {n: F.lit(0.0) for n in quality.TESTED}
    df = spark.createDataFrame(rows, "a double, b double, bad int")
    return df.select("bad", *[(F.col("a") if n == "symbol_share" else F.col("b") if n == "upper_share" else v).alias(n) for n, v in names.items()])


def test_rules_need_conjunctions_and_order(spark):
    """Bad rows have a high and b low, or b very high."""
    rows = [(a / 20, b / 20, int((a > 12 and b < 6) or b > 17)) for a in range(21) for b in range(21) for _ in range(3)]
    rules = quality.learn(labelled(spark, rows), min_precision=0.9)
    assert len(rules) >= 2 and any(len(r) == 2 for r in rules)
    df = labelled(spark, rows)
    caught = F.lit(False)
    for r in rules:
        caught = caught | quality._holds(r, {n: F.col(n) for n in quality.TESTED})
    wrong = df.where(caught != (F.col("bad") == 1)).count()
    assert wrong <= 0.05 * df.count()


def test_noise_gives_no_rules(spark):
    rows = [((i * 37 % 101) / 101, (i * 53 % 97) / 97, i * 7919 % 5 // 4) for i in range(1500)]
    assert quality.learn(labelled(spark, rows)) == []
    assert quality.learn(labelled(spark, [])) == []


def test_main_path_is_native(spark):
    plan = QUERIES["op1_quality_rules"](spark, f"{TESTDATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan
