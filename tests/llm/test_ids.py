"""Ids above two to the 53rd, beside a null one in the same batch, stay whole through every operator."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarnseek.llm import decontamination, line_spread, pieces, quality, simhash, token_files, toxicity, warc
from tests.llm.helpers import BIG, awkward, big_ids

LABELS = "doc_id long, quality int, toxic int"


def ids(df, column="doc_id"):
    return sorted([r[0] for r in df.select(column).collect()], key=str)


EXPECTED = sorted(BIG, key=str)


def test_warc(spark):
    html = "<html>" + "x" * 200
    pages = spark.createDataFrame([(2**60 + 1, "u", html), (2**60 + 3, "v", html), (None, "w", "short"), (2**60 + 5, None, "other")], "page_id long, url string, html string")
    index = warc.write_archives(pages.coalesce(1))
    assert ids(index, "page_id") == sorted([2**60 + 1, 2**60 + 3, None, 2**60 + 5], key=str)
    got = {r["page_id"]: r["refers_to"] for r in warc.read_records(index).collect()}
    assert got == {2**60 + 1: None, 2**60 + 3: 2**60 + 1, None: None, 2**60 + 5: None}


def test_warc_reads_by_bytes_and_keeps_clashing_columns_out(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "a\nb", f"page {i}", "x", "y") for i in range(40)], "page_id long, url string, html string, digest string, first long".replace("first long", "size string"))
    index = warc.write_archives(pages)
    monkeypatch.setattr(warc, "TASK_BYTES", 100)
    rows = warc.read_records(index)
    assert rows.rdd.getNumPartitions() >= index.agg(F.sum("length")).first()[0] // 100
    assert {(r["page_id"], r["url"], r["payload"]) for r in rows.collect()} == {(i, "a%0Ab", f"page {i}".encode()) for i in range(40)}


def test_sentencepiece(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    df = big_ids(spark)
    assert ids(pieces.encode(df, model)) == ids(pieces.decode(pieces.encode(df, model), model)) == ids(pieces.round_trip(df, model)) == EXPECTED


def test_toxicity(spark):
    assert ids(toxicity.assess(big_ids(spark), spark.createDataFrame([], LABELS))) == EXPECTED


def test_simhash(spark):
    df = big_ids(spark)
    assert ids(simhash.near_duplicates(df)) == EXPECTED
    assert ids(simhash.keep_first(df)) == EXPECTED
    copies = big_ids(spark, ("the same text", "the same text", "the same text"))
    assert [r["component_id"] for r in simhash.near_duplicates(copies).collect()] == [2**60 + 1] * 3
    assert ids(simhash.keep_first(copies)) == [2**60 + 1]


def test_token_files(spark):
    index = token_files.write_tokens(big_ids(spark), public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_files.document_starts(index, token_files.read_tokens(index))
    assert ids(rows) == EXPECTED
    assert [np.frombuffer(r["ids"], "<u4")[-1] for r in rows.collect()] == [0, 0, 0]


@pytest.mark.parametrize("keep", [
    lambda d, s: line_spread.clean(d), lambda d, s: simhash.keep_first(d),
    lambda d, s: decontamination.keep_clean(d, s.createDataFrame([], "item_id long, text string")),
    lambda d, s: quality.keep_good(d, s.createDataFrame([], LABELS)),
])
def test_other_columns_are_left_alone(spark, keep):
    """Also those named like the columns that operators use inside."""
    df = awkward(spark)
    kept = keep(df, spark)
    assert kept.columns == df.columns
    extra = df.columns[5:]
    assert all(v == "x" for r in kept.select(*extra).collect() for v in r)
