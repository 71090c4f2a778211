"""The pipeline against plain Python, stage by stage, each on what the stage before it kept."""

import hashlib

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tarnseek.llm import line_spread, quality
from tarnseek.llm.common import written
from tests.compare import TESTDATA
from tests.llm.helpers import awkward, empty
from tests.llm.test_decontamination import slow as slow_hits
from tests.llm.test_line_spread import slow as slow_lines
from tests.llm.test_quality import slow_base_failed, slow_signs
from tests.llm.test_simhash import slow_classes, slow_fingerprint

SF = f"{TESTDATA}/sf0.01"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECE_MODEL)


def rows(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark):
    """The documents and what each stage makes of them."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name))
    return out


def test_all_but_the_last_return_documents(stages):
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:5])


def test_quality_rules(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept, before = {d: t for d, t, _ in rows(stages[1])}, rows(stages[0])
    listed = {r["doc_id"]: r["kept"] for r in quality.assess(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    for doc, text, _ in before:
        assert (doc in kept) == listed[doc]
        if slow_base_failed(slow_signs(text)):
            assert doc not in kept
        elif labels.get(doc) is not None:
            assert (doc in kept) == (labels[doc] == 1)
        assert doc not in kept or kept[doc] == text


def test_line_dedup(stages):
    expected = slow_lines(rows(stages[1]), line_spread.MIN_SITES)
    assert {d: t for d, t, _ in rows(stages[2])} == expected


def test_near_dedup(stages):
    before = rows(stages[2])
    classes = slow_classes([(d, slow_fingerprint(t)) for d, t, _ in before])
    assert {d for d, _, _ in rows(stages[3])} == {c for _, _, c in classes}
    assert set(rows(stages[3])) <= set(before)


def test_decontamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {d for d, _, _, _, c in slow_hits([(d, t) for d, t, _ in rows(stages[3])], items) if c}
    assert hit and set(rows(stages[4])) == {r for r in rows(stages[3]) if r[0] not in hit}


def test_token_ids(stages):
    got = {r["doc_id"]: r for r in stages[5].collect()}
    assert set(got) == {d for d, _, _ in rows(stages[4])}
    for doc, text, _ in rows(stages[4]):
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        packed = np.array(ids, "<u4").tobytes()
        assert bytes(got[doc]["ids"]) == packed and got[doc]["n_tokens"] == len(ids)
        assert got[doc]["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert got[doc]["text"] == LIBRARY.decode(ids)


def test_registered(spark, stages):
    assert queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in oracle_sql()
    names = {f"op{n}_" for n in range(1, 11)}
    assert names == {q[: q.index("_") + 1] for q in queries() if q.startswith("op")}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[5].collect()))


@pytest.mark.parametrize("make", [awkward, empty])
def test_stages_take_awkward_and_empty_tables(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, f"{TESTDATA}/sf0.001")
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert corpus_pipeline.encode_and_decode(spark, docs, "").count() == docs.count()
