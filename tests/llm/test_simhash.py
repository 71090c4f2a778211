import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnseek.llm import common, simhash
from tarnseek.llm.registered import QUERIES
from tests.compare import TESTDATA
from tests.llm.helpers import awkward, docs_of, empty


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(fps):
    """{(id, fp): least id} by looking at all pairs."""
    label = list(range(len(fps)))
    values = np.array([f for _, f in fps], np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ v) <= 4):
            a, b = label[i], label[j]
            if a != b:
                low, high = min(a, b), max(a, b)
                label = [low if x == high else x for x in label]
    least = {}
    for (doc, _), c in zip(fps, label):
        if doc is not None:
            least[c] = min(doc, least.get(c, doc))
    return [(doc, f, least.get(c)) for (doc, f), c in zip(fps, label)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{TESTDATA}/{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = {(d, f"{f:016x}", c) for d, f, c in slow_classes([(r[0], slow_fingerprint(r[1])) for r in docs])}
    got = QUERIES["op9_simhash_near_dedup"](spark, f"{TESTDATA}/{sf}")
    assert {tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()} == expected
    assert got.count() == len(docs)


def test_awkward_rows(spark):
    df = awkward(spark)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    docs = [(r["doc_id"], slow_fingerprint(r["text"])) for r in df.collect()]
    assert got == sorted(slow_classes(docs), key=str)


def test_keep_first_leaves_one_of_each_group(spark):
    df = awkward(spark)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"], r["text"] or "") for r in kept.select("doc_id", "text").collect() if r["doc_id"] is not None)
    assert [i for i, _ in ids] == [1, 1, 3, 6, 7]
    assert sorted(r["text"] or "" for r in kept.where("doc_id is null").collect()) == ["no id at all, though a text"]


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_first(empty(spark)).count() == 0


@pytest.mark.parametrize("shard_rows", [3, 50, 4096])
def test_links_connect_what_all_pairs_connect(spark, shard_rows):
    """Crowded shards: fingerprints that agree in most blocks, dealt over many trees."""
    rng = random.Random(shard_rows)
    fps = {rng.getrandbits(16) << 48 | rng.getrandbits(4) for _ in range(150)}
    fps |= {0x0123456789ABCDEF ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)}
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    found = common.components(simhash.links(df, shard_rows=shard_rows), "test").collect()
    root = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in found}
    got = {}
    for f in fps:
        got.setdefault(root.get(f, f), set()).add(f)
    expected = {}
    for doc, _, c in slow_classes(list(enumerate(fps))):
        expected.setdefault(c, set()).add(fps[doc])
    assert {frozenset(s) for s in got.values()} == {frozenset(s) for s in expected.values()}


def test_search_in_pieces_finds_the_same(monkeypatch):
    monkeypatch.setattr(simhash, "_PAIR_BATCH", 7)
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 10, 300).astype(np.uint64))
    forest = simhash.BKForest(values, np.zeros(len(values), np.int64))
    found = {(int(s), int(m)) for a, b in forest.within(values, np.zeros(len(values), np.int64), 2) for s, m in zip(a, b)}
    assert found == {(i, j) for i, v in enumerate(values) for j in np.flatnonzero(np.bitwise_count(values ^ v) <= 2)}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    found = common.components(spark.createDataFrame(chain + star, "a long, b long"), "test")
    assert found.groupBy("root").agg(F.count("*").alias("n")).orderBy("root").collect() == [(0, 60), (1000, 299)]
    assert common.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_copies_share_a_class(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, [text, text.upper(), text + " tail", "other words entirely"])).collect()}
    assert rows == {0: 0, 1: 0, 2: 0, 3: 3} or rows[1] == 0 and rows[3] == 3
