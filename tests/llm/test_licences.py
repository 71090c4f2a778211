import pytest
from pyspark.sql import functions as F

from tarnseek.llm import licences
from tarnseek.llm.licence_texts import BSD_2, MIT, NOTICES, TEXTS
from tarnseek.llm.registered import QUERIES, SQL
from tests.compare import TESTDATA, connect, differences
from tests.llm.helpers import awkward, docs_of, empty


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    path = f"{TESTDATA}/{sf}"
    df = QUERIES["op6_licence_scan"](spark, path)
    assert differences(df, connect(path), SQL["op6_licence_scan"]) == []
    assert df.where("n_notices > 0").count() > 0
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    return {r["doc_id"]: (r["licence"], r["notices"], r["n_notices"]) for r in licences.scan(df).collect()}


def test_every_known_text_is_found(spark):
    known = [(name, t) for name, texts in TEXTS.items() for t in texts]
    got = scanned(docs_of(spark, [t for _, t in known]))
    assert [got[i][0] for i in range(len(known))] == [name for name, _ in known]
    notices = [(name, t) for name, texts in NOTICES.items() for t in texts]
    got = scanned(docs_of(spark, [f"some words\n  ** {t.upper()} **\nmore" for _, t in notices]))
    assert [got[i] for i in range(len(notices))] == [(None, [name], 1) for name, _ in notices]


def test_equivalent_texts_and_others(spark):
    texts = [
        "MIT Licence\n\nCopyright (c) 2020, Some One <a@b.c>\n(c) 2021 Other\n\n" + MIT.replace("sublicense", "sub-license").replace('"', "'").lower(),
        "   " + BSD_2.replace("\n", "\r\n  ").replace("copyright holder ", "Copyright Owner "),
        MIT + "one more word",
        MIT.replace("free of charge", "for a charge"),
        "A sentence that says copyright is a right.\nAll rights reserved.\nAll Rights Reserved",
        None,
        "",
    ]
    got = scanned(docs_of(spark, texts))
    assert [got[i][0] for i in range(7)] == ["MIT", "BSD-2-Clause", None, None, None, None, None]
    assert got[4] == (None, ["all-rights-reserved"], 2) and got[5] == got[6] == (None, [], 0)


def test_common_licences_and_headers(spark):
    """Texts of other layout than the known ones; the older BSD header; header lines and SPDX forms; a table of one's own."""
    bsd_3 = BSD_2.replace(
        "THIS SOFTWARE IS", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products\nderived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS"
    )
    whole = {n: TEXTS[n][0] for n in ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense")}
    texts = ["Copyright (c) 1998, X\r\nAll rights reserved.\r\n\r\n" + BSD_2, "All rights reserved.\n(c) 1998 X\n\n" + BSD_2, bsd_3]
    texts += ["BSD 3-Clause License\n\nCopyright (c) 2001 A\nCopyright (c) 2002 B\n\n  All rights reserved\n\n" + bsd_3]
    texts += [t.replace("\n", "\r\n  ") for t in whole.values()]
    texts += [whole["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Some One"), whole["GPL-2.0"].split("How to Apply")[0]]
    got = scanned(docs_of(spark, texts))
    assert [got[i][0] for i in range(len(texts))] == ["BSD-2-Clause"] * 2 + ["BSD-3-Clause"] * 2 + list(whole) + ["Apache-2.0", "GPL-2.0"]
    lines = ['# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not', "// SPDX-License-Identifier: GPL-2.0-or-later", "/* SPDX-License-Identifier: BSD-3-Clause */"]
    got = scanned(docs_of(spark, lines))
    assert [got[i][1] for i in range(3)] == [["Apache-2.0"], ["GPL-2.0"], ["BSD-3-Clause"]]
    mine = spark.createDataFrame([("mine", "do what you like")], "name string, text string")
    found = {r["doc_id"]: r["licence"] for r in licences.scan(docs_of(spark, ["Do what you like!", MIT]), mine).collect()}
    assert found == {0: "mine", 1: None}


def test_copyright_lines_only(spark):
    texts = ["Copyright 2020 X", "a\nCopyright (C) X\nb", "copyright law is hard", "(c) X\n© Y\nz"]
    rows = docs_of(spark, texts).orderBy("doc_id").select(licences.canonical(F.col("text"))).collect()
    assert [r[0] for r in rows] == ["", "a b", "copyright law is hard", "z"]


def test_awkward_rows(spark):
    df = awkward(spark)
    out = licences.scan(df)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(r["doc_id"]) for r in df.collect())
    assert out.where("licence is not null or n_notices > 0").count() == 0
    assert licences.scan(empty(spark)).count() == 0
    mit = docs_of(spark, ["x\nReleased under the MIT License."]).union(docs_of(spark, ["x\nReleased under the MIT License."]))
    assert [(r["notices"], r["n_notices"]) for r in licences.scan(mit).collect()] == [(["MIT"], 1)] * 2
