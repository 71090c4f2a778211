import hashlib
import re

import pytest

from tarnseek.llm import decontamination as dec
from tarnseek.llm.registered import QUERIES, SQL
from tests.compare import TESTDATA, connect, differences
from tests.llm.helpers import awkward, docs_of, empty, rows_of

UPPER_TO_LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER_TO_LOWER))


def slow(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in windows}:
                x = tuple(w[i : i + n])
                if len(x) == n and x in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[x]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), ids, bool(hit)))
    return out


def got(docs, benchmark):
    rows = dec.contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "item_ids", "contaminated").collect()
    return sorted((tuple(r) for r in rows), key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql_and_by_hand(spark, sf):
    path = f"{TESTDATA}/{sf}"
    df = QUERIES["op4_decontamination"](spark, path)
    assert differences(df, connect(path), SQL["op4_decontamination"]) == []
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect()
    expected = {(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), c): 1 for d, n, h, i, c in slow(docs, items)}
    assert rows_of(df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == expected
    assert df.where("contaminated").count() > 0


def test_short_items_overlaps_and_repeats(spark):
    items = [(1, "One TWO three"), (2, "a"), (10, "the the the the the the the the the the"), (3, " ".join(f"w{i}" for i in range(14))), (3, "É é x"), (None, "no id"), (4, None), (5, "?!"), (6, "one two three")]
    docs = ["one, two; THREE one two three", "a b a", "the " * 25, " ".join(f"w{i}" for i in range(3, 14)), " ".join(f"w{i}" for i in range(3, 12)), "É é x É É x", "no id", None, "", "zzz", "w0 w1 w2"]
    assert got(docs_of(spark, docs), items_of(spark, items)) == sorted(slow(list(enumerate(docs)), items), key=str)


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(dec, "BLOCK_BYTES", 60)
    items = [(i, " ".join(f"w{i * k % 13}" for k in range(12))) for i in range(5)]
    docs = [" ".join(f"w{i * k % 13}" for k in range(40)) for i in range(6)]
    assert got(docs_of(spark, docs), items_of(spark, items)) == sorted(slow(list(enumerate(docs)), items), key=str)


def test_awkward_rows(spark):
    df = awkward(spark)
    items = [(1, "word word word end here"), (2, "beta gamma"), (3, "no id"), (4, "中文")]
    docs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert got(df, items_of(spark, items)) == sorted(slow(docs, items), key=str)
    clean = dec.keep_clean(df, items_of(spark, items))
    assert clean.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _, _, _, c in slow(docs, items) if not c)


def test_empty_tables(spark):
    items = items_of(spark, [(1, "a b")])
    assert dec.contamination(empty(spark), items).count() == 0
    docs = docs_of(spark, ["a b", None])
    for none in (items_of(spark, []), items_of(spark, [(1, None), (2, "...")])):
        assert got(docs, none) == [(0, 2, 0, [], False), (1, 0, 0, [], False)]
        assert dec.keep_clean(docs, none).count() == 2


def test_corpus_is_not_shuffled_and_native(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    known = dec._prefixes(dec._item_shingles(dec.item_windows(spark.read.parquet(f"{TESTDATA}/sf0.001/benchmark.parquet")).drop("item_id").distinct()))
    plan = dec.corpus_rows(docs, known, [4])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    corpus_side = plan[plan.index("Generate posexplode") :]
    assert "Exchange" not in corpus_side[: corpus_side.index("documents.parquet")]
    plan = QUERIES["op4_decontamination"](spark, f"{TESTDATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
