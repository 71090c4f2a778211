import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnseek.llm import simple8b, token_files
from tarnseek.llm.registered import QUERIES
from tarnseek.llm.wordstore import WordStore
from tests.compare import TESTDATA
from tests.llm.helpers import awkward, empty, rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def expected(docs):
    at, out = 0, {}
    for doc, text in docs:
        ids = ids_of(text)
        out[doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] = 1
        at += len(ids)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_the_library(spark, sf):
    docs = spark.read.parquet(f"{TESTDATA}/{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert rows_of(QUERIES["op10_token_files"](spark, f"{TESTDATA}/{sf}")) == expected(docs)


@pytest.mark.parametrize("highest", [0, 1, 6, 200, 50_000, 1 << 31, (1 << 60) - 1, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 59, 1023, 1024, 1025, 4000])
def test_packing_round_trip(highest, n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, highest, n, dtype=np.uint64, endpoint=True)
    values[100:700] = 0
    words, starts = simple8b.pack(values)
    counts = np.diff(np.append(np.arange(0, n, simple8b.BLOCK), n)) if n else np.zeros(0, int)
    assert (simple8b.unpack(words, starts, counts) == values).all()
    for i in range(len(starts)):  # each block can be read on its own
        end = starts[i + 1] if i + 1 < len(starts) else len(words)
        one = simple8b.unpack(words[starts[i] : end], np.zeros(1, int), counts[i : i + 1])
        assert (one == values[i * simple8b.BLOCK : i * simple8b.BLOCK + counts[i]]).all()


def test_words_hold_as_many_values_as_fit():
    assert len(simple8b.pack(np.full(1024, 1, np.uint64))[0]) == 18
    assert len(simple8b.pack(np.full(8, 40_000, np.uint64))[0]) == 3


@pytest.mark.parametrize("text", ["a b", " a  b", "a \nb", "a\n b", "it's  don't ", "x <|endoftext|> y", "\x1c a\x1c b", "   ", "é 中　文   x", "1 2  3!? ... ", "", " ", "a ", " a", "x\x1f y\x85z \xa0q", "l'été n'a 'Tis they'll", "½ ² ª º µ x", "a\n\nb \r\n c"])
def test_chunks_give_the_ids_of_the_text(text):
    chunks = token_files.chunks_of(text)
    assert "".join(token_files.spelt(c) for c in chunks) == text
    ids, size = token_files._new_words(LIBRARY, ("<|endoftext|>",))(chunks)
    assert ids.tolist() == ids_of(text)[:-1] and size.sum() == len(ids)


def test_random_texts():
    rng = random.Random(5)
    new = token_files._new_words(LIBRARY, ("<|endoftext|>",))
    for _ in range(3000):
        text = "".join(rng.choice("ab Éñ\n\t '.,!12 sx\x00\x1e\xa0中ß<|>\U0001f600") for _ in range(rng.randrange(25)))
        chunks = token_files.chunks_of(text)
        assert new(chunks)[0].tolist() == ids_of(text)[:-1], repr(text)


def test_store_lets_go_of_rare_words():
    store = WordStore(token_files._new_words(LIBRARY), limit=5 * 200)
    for i in range(30):
        words = ["the", "of", f"w{i}", f"x{i}", "the"]
        assert store.ids(words)[0].tolist() == [j for w in words for j in ids_of(" " + w)[:-1]]
        assert len(store.number) <= 9


def test_awkward_rows(spark, tmp_path):
    df = awkward(spark)
    index = token_files.write_tokens(df, PATH, folder=f"file://{tmp_path}")
    rows = token_files.document_starts(index, token_files.read_tokens(index)).collect()
    assert len(rows) == df.count()
    got = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows), key=str)
    assert got == sorted(((r["doc_id"], ids_of(r["text"])) for r in df.collect()), key=str)
    in_order = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in in_order] == np.cumsum([0, *[r["n_tokens"] for r in in_order[:-1]]]).tolist()
    assert [r["doc_id"] for r in in_order] == [None, None, 1, 1, 1, 2, 3, 4, 5, 6, 7]


def test_empty_table(spark):
    index = token_files.write_tokens(empty(spark), PATH)
    assert token_files.document_starts(index, token_files.read_tokens(index)).count() == 0
