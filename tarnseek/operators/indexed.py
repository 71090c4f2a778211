"""Text searches answered from stored postings instead of token arrays.

The postings of the searched terms give, per row, how often each term, phrase
or wildcard occurs and how long the field is. Rows joined to these measures are
filtered and scored like rows with tokens, and the token arrays aren't read.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tarnseek.functions.globs import glob_match
from tarnseek.operators.clauses import And, Clause, Equals, Like, MatchAll, MatchAny, Or, Phrase
from tarnseek.operators.postings import PostingsTable, build_postings, corpus_size, phrase_counts
from tarnseek.operators.relevance import CorpusFigures
from tarnseek.operators.sorted_postings import sorted_postings
from tarnseek.operators.view import TableView
from tarnseek.schema import Kind


class PostingsSource:
    """What a search needs from the index of one TEXT field."""

    def postings(self, terms: list[str] | None) -> DataFrame:
        """Tie columns, term, tf, length, positions; of all terms or some."""
        raise NotImplementedError

    def postings_like(self, glob: str) -> DataFrame:
        """The same of the terms that a glob fits."""
        return self.postings(None).where(glob_match(F.col("term"), glob))

    def sizes(self) -> DataFrame:
        """``docs`` and ``tokens``, to be added up."""
        raise NotImplementedError


class StoredPostings(PostingsSource):
    """Postings of a view's TEXT field, written once to a folder. The view's rows must stay as they are.

    With ``terms`` only theirs are kept, for searches of those; without ``positions``, phrases can't be searched.
    """

    def __init__(
        self, view: TableView, field: str, path: str, buckets: int = 256, terms: list[str] | None = None, positions: bool = True
    ):
        self._spark, self._sizes = view.df.sparkSession, f"{path}/sizes"
        self._terms = PostingsTable(f"{path}/terms", buckets)
        made = sorted_postings(view, field, positions) if terms is None else build_postings(view, field, positions, terms)
        self._terms.write(made, view.tie)
        corpus_size(view, field).write.parquet(self._sizes)

    def postings(self, terms):
        return self._terms.read(self._spark, terms)

    def sizes(self):
        return self._spark.read.parquet(self._sizes)


def needs_token(where: Clause, view: TableView) -> bool:
    """Does every match hold a token of a TEXT field? Only then can postings drive the search."""
    if isinstance(where, And):
        return needs_token(where.left, view) or needs_token(where.right, view)
    if isinstance(where, Or):
        return needs_token(where.left, view) and needs_token(where.right, view)
    return bool(where.text_fields(view))


def token_measures(view: TableView, where: Clause) -> dict[str, dict[tuple, object]]:
    """Per field: what to measure, and the term, placed terms or glob to measure it by."""
    wanted: dict[str, dict[tuple, object]] = {}
    for leaf in where.leaves():
        if not leaf.text_fields(view):
            continue
        found = wanted.setdefault(leaf.field, {("length", leaf.field): None})
        if isinstance(leaf, Equals):
            found["tf", leaf.field, leaf.value] = leaf.value
        elif isinstance(leaf, (MatchAll, MatchAny)):
            for term in leaf.terms(view):
                found["tf", leaf.field, term] = term
        elif isinstance(leaf, Phrase):
            found["phrase", leaf.field, leaf.text] = leaf.positions(view)
        elif isinstance(leaf, Like):
            found["glob", leaf.field, leaf.glob] = leaf.glob
    return wanted


def measured(view: TableView, where: Clause, sources: Mapping[str, PostingsSource]) -> TableView:
    """Rows with at least one of the searched tokens, carrying their measures."""
    names: dict[tuple, str] = {}
    pieces = []
    for field, wanted in token_measures(view, where).items():
        source = sources[field]
        for what in wanted:
            names[what] = f"_x{len(names)}"
        length = F.col("length").alias(names["length", field])
        terms = {what: by for what, by in wanted.items() if what[0] == "tf"}
        if terms:
            held = source.postings(list(terms.values()))
            tfs = [F.when(F.col("term") == t, F.col("tf")).alias(names[w]) for w, t in terms.items()]
            pieces.append((held.select(*view.tie, length, *tfs), len(terms) == 1))
        for what, by in wanted.items():
            if what[0] == "phrase" and by:
                held = source.postings(sorted({t for _, t in by}))
                lengths = held.select(*view.tie, length).distinct()
                counts = phrase_counts(held, view.tie, by).withColumnRenamed("tf", names[what])
                pieces.append((counts.join(lengths, list(view.tie)), True))
            elif what[0] == "glob":
                fits = source.postings_like(by)
                pieces.append((fits.select(*view.tie, length, F.lit(1).alias(names[what])), False))
    if not pieces:
        found = view.df.select(*view.tie).limit(0)
    elif len(pieces) == 1 and pieces[0][1]:
        found = pieces[0][0]
    else:
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p for p, _ in pieces])
        most = [F.max(c).alias(c) for c in every.columns if c not in view.tie]
        found = every.groupBy(*view.tie).agg(*most)
    for name in names.values():
        if name not in found.columns:
            found = found.withColumn(name, F.lit(None).cast("int"))
    tokens = [f.token_column for f in view.spec.fields if f.kind is Kind.TEXT]
    joined = view.df.drop(*tokens).join(found, list(view.tie), "inner")
    return replace(view, df=joined, measured=names)


class IndexFigures(CorpusFigures):
    """Corpus figures read from the index; those of STRING fields still come from the table."""

    def __init__(self, view: TableView, where: Clause, sources: Mapping[str, PostingsSource]):
        self._sources = sources
        super().__init__(view, where)

    def figures_of(self, view, name, terms):
        if name not in self._sources:
            return super().figures_of(view, name, terms)
        source = self._sources[name]
        rows_with = [F.count_if(F.col("term") == t).alias(f"df{i}") for i, t in enumerate(terms)]
        size = source.sizes().agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        held = source.postings(terms).agg(F.struct(*rows_with).alias("terms")).scalar()
        return size.withColumn("terms", held).select("docs", "tokens", "terms.*")
