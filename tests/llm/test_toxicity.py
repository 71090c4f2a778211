import random
import zlib

import pytest
from pyspark.sql import functions as F

from tarnseek.llm import toxicity as tox
from tarnseek.llm.registered import QUERIES
from tests.compare import TESTDATA
from tests.llm.helpers import awkward, docs_of, empty


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.75), ("sf0.1", 0.8)])
def test_held_out_accuracy(spark, sf, least):
    path = f"{TESTDATA}/{sf}"
    rows = QUERIES["op8_toxicity"](spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert rows.count() == docs.count() and rows.where("score < 0 or score > 1 or score is null").count() == 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows.collect())
    known = rows.where("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()
    toxic = [r for r in known if r["toxic"] == 1]
    clean = [r for r in known if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= least * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)


@pytest.mark.parametrize(
    "text, folded",
    [
        ("You 1d10t!!", " you idiot "), ("ІDIОТ here", " idiot here "), ("l0ser, c@t in 2024", " loser cat in 2024 "), ("ïdiöt", " idiot "),
        ("", " "), (None, " "), ("!!! ...", " "), ("hi! wow!", " hi wow "), ("a-b_c", " a b c "), ("ﬁne Ⅳ", " fine iv "),
    ],
)
def test_fold(text, folded):
    assert tox.fold(text) == folded


MODEL = tox.Model({" idio": 4.0, " moron ": 5.0, " mor": 1.0}, [" idiot proof "], (-3.0, 2.0, 1.0))


@pytest.mark.parametrize("text, weight", [("idiot", 4), ("an idiotic moron", 9), ("morons", 1), ("an idiot proof box", 0), ("idiot proofs", 4), ("paranoid idol", 0), ("1D10T", 4)])
def test_matches(text, weight):
    assert tox.matched(MODEL.automaton(), tox.fold(text)) == weight


def test_longer_texts_score_lower():
    automaton = MODEL.automaton()
    scores = [tox.score(MODEL, automaton, "idiot " + "fine " * n) for n in (0, 10, 1000)]
    assert scores == sorted(scores, reverse=True) and len(set(scores)) == 3
    assert tox.score(MODEL, automaton, None) == tox.score(MODEL, automaton, "fine words")


def labelled(spark):
    texts = [f"word{i % 50} some text number{i} and " + ("you are a blorkish fool" if i % 4 == 0 else "blorkish delight is sweet" if i % 4 == 1 else "nothing else") for i in range(400)]
    docs = docs_of(spark, texts)
    return docs, docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) as toxic", "1 as quality")


def test_learns_words_and_leaves_what_clean_rows_have(spark):
    docs, labels = labelled(spark)
    rows = tox.assess(docs, labels).collect()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in rows)


def test_exceptions_are_learned(spark):
    docs, _ = labelled(spark)
    sample = docs.selectExpr("text", "cast(doc_id % 4 = 0 as int) as toxic")
    found = tox._exceptions(sample, tox.Model({" blor": 4.0}))
    assert " blorkish delight " in found and " a blorkish " not in found


def test_only_rows_that_are_not_held_out_are_learned_from(spark):
    docs, labels = labelled(spark)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    assert sorted(map(tuple, tox.assess(docs, labels).collect())) == sorted(map(tuple, tox.assess(docs, flipped).collect()))


def test_awkward_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = awkward(spark)
    out = tox.assess(df, none)
    assert out.count() == df.count() and out.where("predicted = 1 or score > 0.5").count() == 0
    odd = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None), (4, 0), (9, 7)], "doc_id long, toxic int")
    assert tox.assess(df, odd).count() == df.count()
    assert tox.assess(empty(spark), odd).count() == 0


def slow_matched(model, folded):
    """Every entry tried at every word; then every exception phrase at every place."""
    starts = [i for i, c in enumerate(folded[:-1]) if c == " "]
    found = {s: max((w for e, w in model.weights.items() if folded.startswith(e, s)), default=0.0) for s in starts}
    for phrase in model.exceptions:
        for s in starts:
            if folded.startswith(phrase, s):
                for t in starts:
                    if s <= t < s + len(phrase) - 1:
                        found[t] = 0.0
    return sum(found.values())


def test_matches_against_trying_every_entry_at_every_word(spark):
    """On the model learned from the table, over whole texts, and on made-up models with entries within entries."""
    docs, labels = (spark.read.parquet(f"{TESTDATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = tox.learn(tox.sample(docs, labels.where(~tox.held_out(F.col("doc_id")))))
    assert model.weights
    rng = random.Random(11)
    entries = {" " + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) + rng.choice(["", " "]): rng.random() for _ in range(25)}
    made = tox.Model(entries, [" a b ", " ab ba ", " b a "])
    texts = [r["text"] for r in docs.select("text").collect()][:400]
    for m, some in ((model, texts), (made, [" ".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(12)) for _ in range(300)])):
        automaton = m.automaton()
        for text in some:
            folded = tox.fold(text)
            assert tox.matched(automaton, folded) == pytest.approx(slow_matched(m, folded))
