"""Postings: term → rows holding it, with frequency and positions.

Building is row-local: a row's token array is sorted, cut into runs of equal
terms and exploded, so no shuffle is needed until postings are written by term
bucket. Bucket files are salted by row key, since one term may hold a large
part of all postings.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tarnseek.errors import TarnseekError
from tarnseek.functions.columns import let
from tarnseek.functions.globs import glob_match, glob_parts
from tarnseek.operators.relevance import bm25, idf, slot_count
from tarnseek.operators.view import TableView


def _runs(slots: Column, positions: bool, terms: Sequence[str] | None) -> Column:
    """Token slots → array of (term, tf[, positions]), in time n·log n for n tokens."""
    placed = F.filter(
        F.transform(slots, lambda w, i: F.struct(w.alias("w"), i.alias("p"))),
        lambda x: x["w"].isNotNull() if terms is None else x["w"].isin(list(terms)),
    )

    def cut(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]),
        )

        def rows(at: Column) -> Column:
            def row(i: Column, k: Column) -> Column:
                tf = F.coalesce(F.get(at, k + 1), n) - i
                columns = [F.get(s, i)["w"].alias("term"), tf.alias("tf")]
                if positions:
                    run = F.slice(s, i + 1, tf)
                    columns.append(F.transform(run, lambda x: x["p"]).alias("positions"))
                return F.struct(*columns)

            return F.transform(at, row)

        return F.when(n > 0, let(starts, rows))

    return let(F.sort_array(placed), cut)


def build_postings(
    view: TableView, field: str, positions: bool = True, terms: Sequence[str] | None = None
) -> DataFrame:
    """One row per table row and distinct term: tie columns, term, tf, length[, positions].

    With ``terms`` only their postings are made; the length still counts all tokens.
    Those of all terms that are to be written come faster from ``sorted_postings``.
    """
    held = view.with_tokens(field)
    slots = held.token_slots(field)
    # The length is set before the explode, or it would be counted again for each posting.
    counted = held.df.select(*view.tie, slots, slot_count(slots).alias("length"))
    return counted.select(*view.tie, "length", F.inline(_runs(slots, positions, terms)))


def term_stats(postings: DataFrame) -> DataFrame:
    """Per term: rows holding it and occurrences."""
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("total_freq")
    )


def rows_with_all(postings: DataFrame, keys: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """Row keys whose postings cover every term. A row has one posting per term, so they are counted."""
    wanted = sorted(set(terms))
    if not wanted:
        raise TarnseekError("give at least one term")
    found = postings.where(F.col("term").isin(wanted)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_seen"))
    return found.where(F.col("_seen") == len(wanted)).select(*keys)


def rows_with_any(postings: DataFrame, keys: Sequence[str], terms: Sequence[str]) -> DataFrame:
    return postings.where(F.col("term").isin(list(terms))).select(*keys).distinct()


def rows_with_glob(postings: DataFrame, keys: Sequence[str], glob: str) -> DataFrame:
    """Row keys with a term that fits the glob."""
    return postings.where(glob_match(F.col("term"), glob)).select(*keys).distinct()


def phrase_counts(
    postings: DataFrame, keys: Sequence[str], placed: Sequence[tuple[int, str]]
) -> DataFrame:
    """Row keys that hold the terms at the given distances, with how often (``tf``).

    Each occurrence names the place its phrase would start; a start named by
    all parts is a phrase. This is one grouping by (row, start), linear in the
    occurrences, with no self-join.
    """
    placed = sorted(set(placed))
    if not placed:
        raise TarnseekError("a phrase has at least one token")
    parts = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("off")) for p, t in placed])
    own = F.filter(parts, lambda x: x["t"] == F.col("term")).alias("parts")
    starts = (
        postings.where(F.col("term").isin(sorted({t for _, t in placed})))
        .select(*keys, F.explode("positions").alias("at"), own)
        .select(*keys, "at", F.inline("parts"))
        .groupBy(*keys, (F.col("at") - F.col("off")).alias("start"))
        .agg(F.count(F.lit(1)).alias("_seen"))
    )
    # One token stands at a place, so each part names a start at most once.
    whole = starts.where(F.col("_seen") == len(placed))
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("tf"))


def rows_with_phrase(
    postings: DataFrame, keys: Sequence[str], placed: Sequence[tuple[int, str]]
) -> DataFrame:
    return phrase_counts(postings, keys, placed).select(*keys)


def corpus_size(view: TableView, field: str) -> DataFrame:
    """One row: rows that have the field, and their length in all."""
    held = view.with_tokens(field)
    length = slot_count(held.token_slots(field))
    return held.df.agg(F.count_if(length > 0).alias("docs"), F.sum(length).alias("tokens"))


def score_postings(
    postings: DataFrame, keys: Sequence[str], terms: Sequence[str], docs: Column, tokens: Column
) -> DataFrame:
    """BM25 of every row with any of the terms, from postings alone.

    ``docs`` and ``tokens`` are the corpus size. Rows per term come from one
    aggregate over the postings of the terms.
    """
    held = postings.where(F.col("term").isin(list(terms)))
    per_term = [F.count_if(F.col("term") == t).alias(f"df{i}") for i, t in enumerate(terms)]
    figures = held.agg(F.struct(*per_term).alias("figures")).scalar()
    rarity = F.lit(None).cast("double")
    for i, term in enumerate(terms):
        rarity = F.when(F.col("term") == term, idf(docs, figures[f"df{i}"])).otherwise(rarity)
    part = bm25(F.col("tf"), F.col("length"), tokens / docs, rarity)
    return held.groupBy(*keys).agg(F.sum(part).alias("score"))


#: Marks put before and after a term, so that its beginning and end make trigrams of their own.
_EDGES = "\x02", "\x03"


def with_trigrams(terms: DataFrame) -> DataFrame:
    """Each term once for each distinct run of three characters that it has with its edges: ``place``, from 1, and ``gram``."""
    whole = F.concat(F.lit(_EDGES[0]), F.col("term"), F.lit(_EDGES[1])).alias("_whole")
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("_whole") - 2, F.lit(1)))
    placed = terms.select("*", whole).select("*", F.explode(starts).alias("place"))
    rows = placed.withColumn("gram", F.substring("_whole", F.col("place"), F.lit(3)))
    return rows.where(F.instr(F.col("_whole"), F.col("gram")) == F.col("place")).drop("_whole")


def _gram_order(gram: Column) -> Column:
    """The code points of a trigram as one number, by which rows are sorted without comparing texts."""
    points = [F.ascii(F.substring(gram, i, 1)).cast("long") for i in (1, 2, 3)]
    return F.shiftleft(points[0], 42) + F.shiftleft(points[1], 21) + points[2]


def glob_trigrams(glob: str) -> list[str]:
    """Runs of three characters that every term a glob fits has, edges included. None if its stretches are too short."""
    parts = [("text", _EDGES[0]), *glob_parts(glob), ("text", _EDGES[1])]
    runs = [""]
    for kind, text in parts:
        if kind == "text":
            runs[-1] += text
        else:
            runs.append("")
    return list(dict.fromkeys(r[i : i + 3] for r in runs for i in range(len(r) - 2)))


@dataclass(frozen=True)
class TermDictionary:
    """The distinct terms of a postings table, each under all of its trigrams, in one directory per trigram bucket.

    A glob reads the buckets of one of its trigrams and tests the terms there. A glob too short for any
    reads each term once, under the trigram of its beginning.
    """

    path: str
    buckets: int = 64

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def write(self, postings: DataFrame, part: str) -> None:
        """The terms of ``postings`` (term, _bucket) as one part, replacing what it held."""
        terms = postings.groupBy("term", F.col("_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
        rows = with_trigrams(terms).select("term", "bucket", "rows", "gram", (F.col("place") == 1).alias("first"), self._bucket(F.col("gram")).alias("_grams"))
        (
            rows.hint("rebalance", "_grams").withColumn("_order", _gram_order(F.col("gram"))).sortWithinPartitions("_grams", "_order").drop("_order")
            .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_grams").parquet(f"{self.path}/{part}")
        )

    def like(self, spark: SparkSession, glob: str) -> DataFrame:
        """(term, bucket, rows, _upto) of the terms that a glob fits."""
        df = spark.read.option("basePath", self.path).parquet(self.path)
        grams = glob_trigrams(glob)
        if grams:
            # The middle one: the edges' trigrams are shared by the most terms.
            gram = F.lit(grams[len(grams) // 2])
            df = df.where((F.col("_grams") == self._bucket(gram)) & (F.col("gram") == gram))
        else:
            df = df.where("first")
        return df.where(glob_match(F.col("term"), glob)).select("term", "bucket", "rows", "_upto")


@dataclass(frozen=True)
class PostingsTable:
    """Postings on disk, in one directory per term bucket, sorted by term inside files."""

    path: str
    buckets: int = 256
    salts: int = 16

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def write(self, postings: DataFrame, keys: Sequence[str], part: str = "") -> None:
        """Write one part, replacing what it held.

        The adaptive planner splits the task of a bucket that gets too much,
        such as that of a hot term, and merges small ones. Where it is turned
        off, each bucket is spread over ``salts`` tasks instead.
        """
        adaptive = postings.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
        salt = F.lit(0) if adaptive else F.pmod(F.xxhash64(*keys), F.lit(self.salts))
        (
            postings.withColumns({"_bucket": self._bucket(F.col("term")), "_salt": salt})
            .hint("rebalance", "_bucket", "_salt")
            .drop("_salt")
            .sortWithinPartitions("_bucket", "term")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy("_bucket")
            .parquet(f"{self.path}/{part}" if part else self.path)
        )

    def part(self, spark: SparkSession, part: str) -> DataFrame:
        """One part, with the bucket of each posting."""
        return spark.read.parquet(f"{self.path}/{part}")

    def read_terms(self, spark: SparkSession, terms: DataFrame) -> DataFrame:
        """The postings of the terms (term, bucket) of a table: only their buckets are read, pruned when the terms are known."""
        df = spark.read.option("basePath", self.path).parquet(self.path)
        wanted = terms.select(F.col("term").alias("_term"), F.col("bucket").alias("_in"))
        return df.join(wanted, (F.col("_bucket") == F.col("_in")) & (F.col("term") == F.col("_term")), "left_semi").drop("_bucket")

    def read(self, spark: SparkSession, terms: Sequence[str] | None = None) -> DataFrame:
        """All postings, or those of some terms: only their buckets are read."""
        df = spark.read.option("basePath", self.path).parquet(self.path)
        if terms is not None:
            buckets = [F.col("_bucket") == self._bucket(F.lit(t)) for t in terms]
            df = df.where(reduce(or_, buckets) & F.col("term").isin(list(terms)))
        return df.drop("_bucket")
