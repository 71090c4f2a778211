"""Licence scans: whole texts looked up by the digest of their canonical form.

A text's canonical form has A-Z in lower case, no copyright lines, single spaces for all that
isn't a letter or digit, and one spelling for words that mean the same. Its digest is hash-joined
to those of known licences; so is that of each of its lines, for notices that stand alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnseek.llm.common import ascii_lower, row_key, text_of
from tarnseek.llm.licence_texts import EQUIVALENTS, NOTICES, TEXTS

_LEAD = r"[ \t#*/;-]*"
_RIGHTS = _LEAD + r"all rights reserved[ \t\r.*/]*"
#: A line that only says who holds the copyright, with the line break before it. It needs a year or a mark, so that a sentence about copyright stays.
#: A line beside it that only reserves all rights goes with it.
COPYRIGHT_LINE = (
    rf"(^|\n)({_RIGHTS}\n)?{_LEAD}(copyright[ \t]*(\(c\)|©|[0-9])|\(c\)|©)[^\n]*"
    rf"(\n([ \t\r#*/;-]*\n)?{_RIGHTS}(?m:$))?"
)


def canonical(text: Column) -> Column:
    """The form that is compared. Letters beyond ASCII stay as they are."""
    out = F.regexp_replace(ascii_lower(text), COPYRIGHT_LINE, "$1")
    out = F.trim(F.regexp_replace(out, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    for other, usual in EQUIVALENTS:
        out = F.replace(out, F.lit(other), F.lit(usual))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


#: Known texts: lists by name, or a table with the string columns name and text.
Known = dict[str, list[str]] | DataFrame


def _table(spark: SparkSession, given: Known) -> DataFrame:
    if isinstance(given, DataFrame):
        return given.select("name", "text")
    return spark.createDataFrame([(name, t) for name, all_ in given.items() for t in all_], "name string, text string")


def known(spark: SparkSession, texts: Known = TEXTS, notices: Known = NOTICES) -> DataFrame:
    """(digest, licence, notice) of the known texts; one row per digest, of equal texts the first name."""
    both = [_table(spark, given).withColumn("notice", F.lit(notice)) for given, notice in ((texts, False), (notices, True))]
    table = both[0].unionByName(both[1]).select(digest(F.col("text")).alias("digest"), F.col("name").alias("licence"), "notice")
    return table.groupBy("digest", "notice").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, texts: Known = TEXTS, notices: Known = NOTICES) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key, licence, notices and n_notices.

    licence is that of which the whole text is a copy, or null; notices are the sorted names of licences that some line
    names, and n_notices counts such lines. Null and empty texts have none. Rows with equal id and text get equal
    results. Other columns aren't read. Known texts given as lists are broadcast; the join to tables of them is left to the planner.
    """
    text = text_of()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[A-Za-z]"))
    units = F.concat(
        F.array(F.struct(F.lit(False).alias("notice"), digest(text).alias("digest"))),
        F.transform(lines, lambda x: F.struct(F.lit(True).alias("notice"), digest(x).alias("digest"))),
    )
    rows = docs.select("doc_id", row_key().alias("row_key"), F.explode(units).alias("u")).select("doc_id", "row_key", "u.*")
    by_digest = known(docs.sparkSession, texts, notices)
    if not isinstance(texts, DataFrame) and not isinstance(notices, DataFrame):
        by_digest = F.broadcast(by_digest)
    found = rows.join(by_digest, ["digest", "notice"], "left")
    is_whole, name = ~F.col("notice"), F.col("licence")
    found = found.groupBy("doc_id", "row_key").agg(
        F.count(F.when(is_whole, 1)).alias("rows"),
        F.max(F.when(is_whole, name)).alias("licence"),
        F.array_sort(F.collect_set(F.when(~is_whole, name))).alias("notices"),
        F.count(F.when(~is_whole, name)).alias("lines"),
    )
    # Repeated rows met in one group: give them back.
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return found.select("doc_id", "row_key", "licence", "notices", (F.col("lines") / F.col("rows")).cast("long").alias("n_notices"))
