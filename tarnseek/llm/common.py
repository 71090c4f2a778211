"""What the operators of this package share: written tables, row keys, connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnseek.sources.storage import work_folder

#: ASCII white space, as in the word pattern ``[^\x20\x09-\x0D]+``.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share."""
    return work_folder(spark, f"llm-{purpose}")


def shared_uri(spark: SparkSession, purpose: str) -> str:
    """``shared_folder`` with its scheme, for files that tasks read and write themselves."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark, purpose))
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read again.

    Cuts the lineage: a lost executor costs a new read of the files, not the work.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def row_key(text: str = "text") -> Column:
    """Tells rows with one id apart: a hash of the text. Equal rows share it."""
    return F.xxhash64(text_of(text))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else. ``lower`` is quicker and does the same where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, worked out once per row.

    The optimizer puts an expression wherever its name is used, so one used inside a
    lambda would be worked out again for each element. A lambda's own variable isn't.
    """
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, root) of each node that has an edge; root is the least node of its component.

    ``edges`` has two long columns, a and b. Large-star and small-star steps take turns, each
    a grouped minimum with map-side partials and a join on the node, until nothing changes.
    Each round is a written table; only a count and a checksum come to the driver.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), purpose)
    state = _state(now)
    while state[0]:
        now = written(_small_star(_large_star(now)), purpose)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    smaller = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return smaller.union(own).where("a <> b").distinct()


def combinations_of(n: int, k: int) -> Sequence[tuple[int, ...]]:
    from itertools import combinations

    return list(combinations(range(n), k))
