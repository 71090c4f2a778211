import pytest

from tarnseek.llm import line_spread
from tarnseek.llm.registered import QUERIES, SQL
from tests.compare import TESTDATA, connect, differences
from tests.llm.helpers import awkward, docs_of, empty


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    path = f"{TESTDATA}/{sf}"
    df = QUERIES["op5_line_dedup"](spark, path)
    assert differences(df, connect(path), SQL["op5_line_dedup"]) == []
    assert sf == "sf0.001" or df.where("n_removed > 0").count() > 0


def slow(rows, min_sites):
    """rows: (doc_id, text, source), ids distinct."""
    sites, first = {}, {}
    for doc, text, source in sorted(rows):
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\r\n\x0b\x0c"):
                sites.setdefault(line, set()).add(source or "")
                first.setdefault(line, (doc, at))
    out = {}
    for doc, text, _ in rows:
        stay = [x for at, x in enumerate((text or "").split("\n")) if len(sites.get(x, ())) < min_sites or first[x] == (doc, at)]
        out[doc] = "\n".join(stay) if text is not None else None
    return out


@pytest.mark.parametrize("min_sites", [2, 3, 40])
def test_against_counting_by_hand(spark, min_sites):
    texts = [f"common line\nown {i}\n\n  \ncommon line\nseen {i % 4}" for i in range(60)] + [None, "", "\n\n", "common line"]
    sources = [f"s{i % 50}" for i in range(len(texts) - 1)] + [None]
    df = docs_of(spark, texts, sources)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    got = {r["doc_id"]: r["text"] for r in line_spread.clean(df, min_sites).collect()}
    assert got == slow(rows, min_sites)


def test_near_lines_are_counted_exactly(spark, monkeypatch):
    """All estimates count as near: the exact counts alone decide, to the same result."""
    texts = [f"line {j}\nrest {i}" for i in range(120) for j in (i % 7,)]
    df = docs_of(spark, texts, [f"s{i}" for i in range(120)])
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    expected = slow(rows, 18)
    assert {r["doc_id"]: r["text"] for r in line_spread.clean(df, 18).collect()} == expected
    monkeypatch.setattr(line_spread, "NEAR", 0.99)
    assert {r["doc_id"]: r["text"] for r in line_spread.clean(df, 18).collect()} == expected


def test_columns_and_n_chars(spark):
    df = docs_of(spark, ["a b\nshared", "shared\nc", "shared"], ["x", "y", "z"])
    out = line_spread.clean(df, 3)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(0, "a b\nshared", 10), (1, "c", 1), (2, "", 0)]


def test_awkward_rows(spark):
    df = awkward(spark)
    out = line_spread.clean(df, 2)
    assert out.columns == df.columns and out.count() == df.count()
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r["doc_id"]) for r in df.collect())
    assert out.where("doc_id = 3").first()["text"] is None
    assert line_spread.clean(empty(spark)).count() == 0
