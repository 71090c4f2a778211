import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tarnseek.llm import spelling
from tarnseek.llm.registered import QUERIES
from tests.compare import TESTDATA
from tests.llm.helpers import awkward, docs_of, empty, rows_of

AZ = {c: c + 32 for c in range(65, 91)}


def slow_vocabulary(docs):
    found = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(AZ)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def edits(word):
    """All of a word's shortened forms, by the place left out."""
    return {(word[:i] + word[i + 1 :]) for i in range(len(word))}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return short in edits(long)


def slow_variants(vocab, ratio=5):
    by_short = defaultdict(set)
    for w in vocab:
        for s in edits(w) | {w}:
            by_short[s].add(w)
    around = {w: {x for s in edits(w) | {w} for x in by_short[s] if near(w, x)} for w in vocab}
    form = {}
    for w, xs in around.items():
        best = min(xs, key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= ratio * vocab[w] else None
    rows = {}
    for w, n in vocab.items():
        root = w
        while form[root]:
            root = form[root]
        rows[w] = (w, form[w], root, n, len(around[w]), vocab[form[w]] if form[w] else None)
    return Counter(rows.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_all_words(spark, sf):
    docs = spark.read.parquet(f"{TESTDATA}/{sf}/documents.parquet").select("doc_id", "text").collect()
    expected = slow_variants(slow_vocabulary(docs))
    got = rows_of(QUERIES["op13_spelling_variants"](spark, f"{TESTDATA}/{sf}").select("word", "form", "root", "n", "n_near", "form_n"))
    assert got == expected
    assert sum(r[1] is not None for r in got) > 0


@pytest.mark.parametrize("shard_letters", [7, 60, 1 << 16])
def test_crowded_words_over_many_shards(spark, shard_letters):
    """Words that all begin or end alike, of few letters, so that many are near."""
    rng = random.Random(shard_letters)
    words = {"inter" + "".join(rng.choice("abé") for _ in range(rng.randrange(1, 6))) for _ in range(150)}
    words |= {"".join(rng.choice("abÿ") for _ in range(rng.randrange(1, 6))) + "ation" for _ in range(150)}
    words |= {"z" * n for n in range(6, 12)} | {"y" * 3000, "y" * 3001, "y" * 1500 + "x" + "y" * 1499}
    vocab = {w: rng.choice([5, 5, 6, 25, 30, 125, 700]) for w in sorted(words)}
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    assert rows_of(spelling.variants(df, shard_letters=shard_letters)) == slow_variants(vocab)


def test_forms_are_followed_to_the_last(spark):
    words = ["abcdefghij"[: 10 - i] for i in range(5)]
    vocab = {w: 5 * 6**i for i, w in enumerate(reversed(words))}
    rows = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(list(vocab.items()), "word string, n long")).collect()}
    assert set(rows.values()) == {"abcdefghij"}


def test_awkward_rows_and_empty_tables(spark):
    df = awkward(spark)
    runs = spelling.runs_of(df)
    expected = Counter((r["doc_id"], w) for r in df.collect() for w in re.findall("[A-Za-zÀ-ÿ]{6,}", (r["text"] or "").translate(AZ)))
    assert rows_of(runs) == expected
    assert spelling.runs_of(empty(spark)).count() == 0
    nothing = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(nothing).count() == 0
    one = spelling.variants(spark.createDataFrame([("single", 9)], "word string, n long")).collect()
    assert [tuple(r) for r in one] == [("single", None, "single", 9, 0, None)]


def test_ids_above_two_to_the_53(spark):
    """Slips depend on the whole id, also beside a null one."""
    docs = [(2**60 + 1, "wonderful " * 300), (2**60 + 3, "wonderful " * 300), (None, "wonderful " * 300)]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    path = df.sparkSession.conf.get("spark.checkpoint.dir") + "/spelling-ids"
    df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    assert rows_of(QUERIES["op13_spelling_variants"](spark, path)) == slow_variants(slow_vocabulary(docs))
    assert docs_of(spark, ["abcdef"]).count() == 1
