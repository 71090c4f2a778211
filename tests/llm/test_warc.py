import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tarnseek.llm import warc
from tarnseek.llm.registered import QUERIES, SQL
from tests.compare import TESTDATA, connect, differences

SCHEMA = "page_id long, url string, html string, payload string, size long, file string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    path = f"{TESTDATA}/{sf}"
    assert differences(QUERIES["op2_warc"](spark, path), connect(path), SQL["op2_warc"]) == []


def read(index):
    return sorted(((r["page_id"], r["record_type"], r["refers_to"], r["url"], bytes(r["payload"]) if r["payload"] is not None else None, r["payload_bytes"], r["payload_digest"]) for r in warc.read_records(index).collect()), key=str)


BIG = "<p>é</p>" * 30


def expected(page, kind, refers, url, text):
    data = text.encode()
    return page, kind, refers, url, data if kind == "response" else None, len(data), hashlib.sha256(data).hexdigest()


def test_copies_nulls_and_repeats(spark):
    rows = [(5, "u5", BIG), (3, "u3", BIG), (3, "u3", BIG), (None, None, BIG), (9, "u\r\n9", None), (8, "u8", ""), (7, "u7", "short"), (6, "u6", "short"), (None, "a", BIG + "!"), (None, "b", BIG + "!")]
    got = read(warc.write_archives(pages(spark, rows)))
    assert got == sorted(
        [
            expected(5, "revisit", 3, "u5", BIG), expected(3, "response", None, "u3", BIG), expected(3, "response", None, "u3", BIG),
            expected(None, "revisit", 3, None, BIG), expected(9, "response", None, "u%0D%0A9", ""), expected(8, "response", None, "u8", ""),
            expected(7, "response", None, "u7", "short"), expected(6, "response", None, "u6", "short"),
            expected(None, "response", None, "a", BIG + "!"), expected(None, "response", None, "b", BIG + "!"),
        ],
        key=str,
    )


def test_hot_payload_and_long_page(spark):
    rows = [(i, f"u{i}", BIG if i % 3 == 0 else f"{BIG}{i}") for i in range(300)] + [(1000, "long", "x" * 3_000_000)]
    got = read(warc.write_archives(pages(spark, rows).repartition(4)))
    assert [g for g in got if g[1] == "revisit"] == sorted((expected(i, "revisit", 0, f"u{i}", BIG) for i in range(3, 300, 3)), key=str)
    assert max(g[5] for g in got) == 3_000_000


def test_index_first_then_only_the_selected_ranges(spark, monkeypatch):
    rows = [(i, f"u{i}", f"{BIG}{i}") for i in range(200)]
    index = warc.write_archives(pages(spark, rows))
    chosen = read(index.where("page_id % 50 = 7"))
    assert chosen == sorted((expected(i, "response", None, f"u{i}", f"{BIG}{i}") for i in (7, 57, 107, 157)), key=str)
    total = index.agg(F.sum("length")).first()[0]
    ranges = [r for _, rows in index.toPandas().sort_values(["file", "offset"]).groupby("file") for r in warc._coalesced(rows["offset"].tolist(), rows["length"].tolist())]
    assert total < warc.READ_BYTES and len(ranges) == index.select("file").distinct().count()
    monkeypatch.setattr(warc, "READ_BYTES", 1500)
    monkeypatch.setattr(warc, "GAP_BYTES", 0)
    assert len(read(index)) == 200


def test_archives_are_standard_gzip_members(spark, tmp_path):
    index = warc.write_archives(pages(spark, [(1, "http://a", BIG), (2, "http://b", BIG)]), folder=f"file://{tmp_path}").collect()
    whole = b"".join(gzip.open(r["file"].removeprefix("file://")).read() for r in {r["file"]: r for r in index}.values())
    assert whole.count(b"WARC/1.1\r\n") == 2 and b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" in whole
    for r in index:
        with open(r["file"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            assert warc.parse(gzip.decompress(f.read(r["length"])))["page_id"] == r["page_id"]


def test_files_roll_over(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    index = warc.write_archives(pages(spark, [(i, "u", f"{BIG}{i}") for i in range(60)]).coalesce(1), folder=f"file://{tmp_path}")
    assert index.select("file").distinct().count() > 3 and len(read(index)) == 60


def test_damaged_record_is_noticed():
    whole = warc.record(1, "u", b"abc", "d", 3, None, "2000-01-01T00:00:00Z")
    assert warc.parse(whole)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(whole[:-2])


def test_empty_table(spark):
    assert read(warc.write_archives(pages(spark, []))) == []
