"""Small tables with the awkward cases, and rows in a comparable form."""

from collections import Counter

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return; here they are just more columns of the input.
CLASHES = ["row_key", "fp", "words", "kept", "n_words", "root", "line", "score", "hash", "count", "digest", "id", "_tsk_key", "_tsk_doc", "_tsk_row", "_tsk_n", "_tsk_removed", "_tsk_lines", "own_key", "gone_at", "head_rows"]
LONG = "alpha beta gamma delta " * 30_000


def docs_of(spark, texts, sources=None):
    """documents with ids 0, 1, ... and the given texts."""
    rows = [(i, t, "en", sources[i] if sources else f"src{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, one id with two texts, clashing columns."""
    one = ("word " * 60 + "end here", "en", "src1", 308)
    rows = [
        (1, *one),
        (1, *one),
        (1, "another text under the same id", "en", "src2", 30),
        (2, *one),
        (3, None, "en", "src1", None),
        (4, "", None, None, 0),
        (5, " \n\t \n", "de", "src3", 5),
        (None, "no id at all, though a text", None, None, 27),
        (None, None, None, None, None),
        (6, LONG, "en", "src1", len(LONG)),
        (7, "É Ünï 中文 \U0001f600 Kelvin K dotted İ", "fr", "src1", 30),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


BIG = [2**60 + 1, 2**60 + 3, None]


def big_ids(spark, texts=("one text here", "and a second one", "no id but a text"), schema=SCHEMA):
    """Ids above two to the 53rd and a null one, in one batch."""
    rows = [(i, t, "en", "src1", len(t)) for i, t in zip(BIG, texts)]
    return spark.createDataFrame(rows, schema).coalesce(1)
