import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tarnseek.llm import pieces
from tarnseek.llm.registered import QUERIES
from tests.compare import TESTDATA
from tests.llm.helpers import awkward, empty, rows_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def table():
    with open(MODEL, "rb") as f:
        return pieces.merge_table(f.read())


def expected_row(doc, text):
    ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
    sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    return doc, len(ids), sha, hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_the_library(spark, sf):
    docs = spark.read.parquet(f"{TESTDATA}/{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(QUERIES["op3_sentencepiece"](spark, f"{TESTDATA}/{sf}")) == {expected_row(*d): 1 for d in docs}


def random_text(rng):
    kind = rng.random()
    if kind < 0.4:
        return "".join(LIBRARY.id_to_piece(rng.randrange(259, 32000)) for _ in range(rng.randrange(1, 30))).replace("▁", " ")
    if kind < 0.6:
        return "".join(rng.choice("the anoisr  \n▁<0x>") for _ in range(rng.randrange(1, 60)))
    if kind < 0.8:
        points = [32, 32, 97, 0x4E2D, 0x1F600, 0xE9, 0x301, 0xFFFD, 0, 9, 10, 0x2581, 0x3000, 0xA0]
        return "".join(chr(rng.choice(points)) for _ in range(rng.randrange(40)))
    return " " * rng.randrange(80) + "the" * rng.randrange(40) + " " * rng.randrange(40)


FIXED = ["", " ", "  ", "\n", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "a" * 5000, " " * 5000, "中文" * 3000, "the" * 1500, "x  y " * 300_000]


def test_random_and_extreme_texts(table):
    rng = random.Random(7)
    texts = [random_text(rng) for _ in range(3000)] + FIXED
    got = pieces.encode_texts(table, pieces.word_store(table), texts)
    assert [g.tolist() for g in got] == LIBRARY.encode(texts, add_bos=True, add_eos=True)


def test_heap_and_rounds_agree(table, monkeypatch):
    rng = random.Random(8)
    words = ["▁" + random_text(rng).replace(" ", "▁") for _ in range(500)]
    by_rounds = pieces.merge_words(table, words)
    monkeypatch.setattr(pieces, "_LONG_WORD", 0)
    by_heap = pieces.merge_words(table, words)
    assert (by_rounds[0] == by_heap[0]).all() and (by_rounds[1] == by_heap[1]).all()


def test_texts_in_parts_and_a_full_store(table, monkeypatch):
    monkeypatch.setattr(pieces, "_CHUNK", 50)
    texts = ["some words " * 40, "a   b  c " * 20, "short", "", "x" * 300]
    store = pieces.word_store(table)
    store.limit = 3
    got = pieces.encode_texts(table, store, texts)
    assert [g.tolist() for g in got] == LIBRARY.encode(texts, add_bos=True, add_eos=True)


def test_awkward_rows(spark):
    df = awkward(spark)
    got = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(
        ((r["doc_id"], LIBRARY.decode(LIBRARY.encode(r["text"] or ""))) for r in df.collect()), key=str
    )
    assert pieces.encode(empty(spark), MODEL).count() == 0


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    with open(MODEL, "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    proto.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        pieces.merge_table(proto.SerializeToString())
