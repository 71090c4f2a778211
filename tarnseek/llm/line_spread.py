"""Line dedup by the spread of a line over sites.

Each line's sites go into a HyperLogLog sketch; sketches of one line hash merge as partial
aggregates. Lines whose estimate is near the threshold get an exact count of distinct sites,
and lines on enough sites are boilerplate: they stay in the first document that has them and are
taken out of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnseek.functions.columns import fresh_names
from tarnseek.llm.common import let, row_key, text_of, written

MIN_SITES = 10
#: Estimates this far from the threshold, in parts of it, are counted exactly. Twelve bits of buckets err by 1.6 %.
NEAR = 0.2
LG_BUCKETS = 12


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, site, at and two hashes (128 bits) of every line that has a word. A null source is a site of its own."""
    rows = docs.select("doc_id", row_key().alias("row_key"), F.coalesce("source", F.lit("")).alias("site"), F.posexplode(lines_of(text_of())).alias("at", "line"))
    rows = rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select("doc_id", "row_key", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first): lines on at least ``min_sites`` sites, and (doc_id, row_key, at) of the first of each.

    first is the smallest doc_id, nulls before it; of rows with one id the one with the smaller text hash.
    """
    lines = _lines(docs)
    place = F.struct("doc_id", "row_key", "at")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_BUCKETS))).alias("sites"), F.min(place).alias("first"))
    spread = written(spread.where(F.col("sites") >= (1 - NEAR) * min_sites), "spread")
    sure = F.col("sites") > (1 + NEAR) * min_sites
    near = spread.where(~sure).select("h1", "h2")
    exact = lines.select("h1", "h2", "site").join(near, ["h1", "h2"], "left_semi").distinct()
    exact = exact.groupBy("h1", "h2").count().where(F.col("count") >= min_sites).select("h1", "h2")
    found = spread.where(sure).unionByName(spread.join(exact, ["h1", "h2"], "left_semi"))
    return written(found.select("h1", "h2", "first"), "boilerplate")


def _cleaned(docs: DataFrame, min_sites: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with texts cleaned and two more columns, and their names: lines with a word, and those taken out."""
    lines = _lines(docs)
    drop = boilerplate(docs, min_sites)
    n_lines, n_removed, at, doc, key, own = fresh_names(docs, "_tsk_lines", "_tsk_removed", "gone_at", "gone_doc", "gone_key", "own_key")
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.row_key") == F.col("row_key")) & (F.col("first.at") == F.col("at"))
    marked = lines.select("doc_id", "row_key", "at", "h1", "h2").join(drop, ["h1", "h2"]).where(~same)
    marked = marked.groupBy("doc_id", "row_key").agg(F.collect_set("at").alias(at)).withColumnsRenamed({"doc_id": doc, "row_key": key})
    rows = docs.withColumn(own, row_key())
    rows = rows.join(marked, rows["doc_id"].eqNullSafe(marked[doc]) & (rows[own] == marked[key]), "left")
    removed = F.coalesce(F.size(at), F.lit(0)).cast("long")

    def left(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(at))
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")

    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(let(lines_of(F.col("text")), left))
    columns = [text.alias("text") if c == "text" else rows[c] for c in docs.columns]
    has_word = F.filter(lines_of(text_of()), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*columns, F.size(has_word).cast("long").alias(n_lines), removed.alias(n_removed)), [n_lines, n_removed]


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with texts cleaned, and two more columns: _tsk_lines and _tsk_removed, both of lines with a word.

    Where ``docs`` has a column of such a name it stays, and the new one gets another underscore before it.

    The first occurrence of a line stays, so no line is lost to the corpus; where a document has it again, that goes too.
    Null texts stay null, and texts may become empty. Repeated rows are cleaned alike. All rows and columns stay.
    """
    return _cleaned(docs, min_sites)[0]


def clean(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with cleaned texts and the same columns; n_chars, where there is one, is that of the new text."""
    rows, (_, removed) = _cleaned(docs, min_sites)
    columns = [F.col(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        n_chars = F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        columns[docs.columns.index("n_chars")] = n_chars.alias("n_chars")
    return rows.select(*columns)
