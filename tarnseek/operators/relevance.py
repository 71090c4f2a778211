"""Relevance: BM25 over the clauses of a search.

A TEXT token scores by BM25; a STRING equality scores its rarity; a range,
wildcard or whole-table clause scores 1. AND and OR add up the clauses that
match.

Corpus figures (rows, mean length, rows per term) come from one aggregate with
map-side partials, read back as a scalar subquery: no rows are shuffled and
nothing but one row of numbers is shared.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from tarnseek.functions.columns import let
from tarnseek.operators.clauses import (
    And,
    Clause,
    Equals,
    MatchAll,
    MatchAny,
    Or,
    Phrase,
    has_slot,
    matching,
)
from tarnseek.operators.view import TableView
from tarnseek.schema import Kind

# --- fixed values -----------------------------------------------------------
K1 = 1.2
B = 0.75
# Lengths up to here are kept exactly when stored in one byte.
_EXACT_LENGTHS = 24
_KEPT_BITS = 4


def idf(rows: Column, rows_with_term: Column) -> Column:
    return F.log(1 + (rows - rows_with_term + 0.5) / (rows_with_term + 0.5))


def bm25(tf: Column, length: Column, mean_length: Column, rarity: Column) -> Column:
    norm = K1 * (1 - B + B * length / mean_length)
    return rarity * tf * (K1 + 1) / (tf + norm)


def rounded_length(length: Column) -> Column:
    """A length as kept in one byte: exact below 24, then four leading binary digits."""
    rest = (length - _EXACT_LENGTHS).cast("long")
    shift = F.greatest(F.length(F.bin(rest)) - _KEPT_BITS, F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("long")
    kept = F.lit(_EXACT_LENGTHS) + rest - F.pmod(rest, step)
    return F.when(length < _EXACT_LENGTHS, length.cast("long")).otherwise(kept)


def slot_count(slots: Column) -> Column:
    """Length of a field in tokens; the slots of stop words don't count."""
    return F.size(F.array_compact(slots))


def term_frequency(slots: Column, term: str) -> Column:
    return F.size(F.filter(slots, lambda w: w == term))


def _scored_terms(view: TableView, leaf: Clause) -> list[tuple[str, str]]:
    """(field, term) pairs of a leaf that score by rarity."""
    if isinstance(leaf, (MatchAll, MatchAny, Phrase)):
        return [(leaf.field, t) for t in leaf.terms(view)]
    if isinstance(leaf, Equals) and view.spec.field(leaf.field).kind in (Kind.TEXT, Kind.STRING):
        return [(leaf.field, leaf.value)]
    return []


def ranks_by_score(view: TableView, where: Clause | None) -> bool:
    """Can rows differ in score? If not, scoring is left out."""
    if where is None:
        return False
    leaves = list(where.leaves())
    has_or = any(isinstance(c, Or) for c in _nodes(where))
    return has_or or any(
        view.spec.field(f).kind is Kind.TEXT for leaf in leaves for f, _ in _scored_terms(view, leaf)
    )


def _nodes(clause: Clause):
    yield clause
    if isinstance(clause, (And, Or)):
        yield from _nodes(clause.left)
        yield from _nodes(clause.right)


class CorpusFigures:
    """Figures of the whole table (not just the hits) for the terms of a search.

    ``scalars`` are one-row subqueries to be added to the hits as columns; the
    methods read those columns.
    """

    def __init__(self, view: TableView, where: Clause):
        self.scalars: dict[str, Column] = {}
        self._places: dict[tuple, tuple[str, str]] = {}
        for name, terms in self.terms_of(view, where).items():
            self._add(name, terms, self.figures_of(view, name, terms))

    @staticmethod
    def terms_of(view: TableView, where: Clause) -> dict[str, list[str]]:
        """The terms that score by rarity, by field."""
        pairs = list(dict.fromkeys(p for leaf in where.leaves() for p in _scored_terms(view, leaf)))
        return {name: [t for f, t in pairs if f == name] for name in dict.fromkeys(f for f, _ in pairs)}

    def _add(self, name: str, terms: list[str], figures: DataFrame) -> None:
        holder = f"_figures{len(self.scalars)}"
        self.scalars[holder] = figures.select(F.struct("*").alias("figures")).scalar()
        self._places[name, "docs"] = holder, "docs"
        self._places[name, "tokens"] = holder, "tokens"
        for i, term in enumerate(terms):
            self._places[name, "term", term] = holder, f"df{i}"

    def figures_of(self, view: TableView, name: str, terms: list[str]) -> DataFrame:
        """One row: rows that have the field, their tokens, and rows with each term.

        Each row's part is worked out first, then added up in one pass.
        """
        if view.spec.field(name).kind is Kind.TEXT:
            whole = view.with_tokens(name)
            slots = whole.token_slots(name)
            parts = [slot_count(slots).alias("n")]
            parts += [has_slot(slots, t).alias(f"has{i}") for i, t in enumerate(terms)]
        else:
            whole = view
            parts = [F.when(F.col(name).isNotNull(), 1).otherwise(0).alias("n")]
            parts += [(F.col(name) == t).alias(f"has{i}") for i, t in enumerate(terms)]
        sums = [F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("tokens")]
        sums += [F.count_if(F.col(f"has{i}")).alias(f"df{i}") for i in range(len(terms))]
        return whole.df.select(*parts).agg(*sums)

    def _at(self, *what: str) -> Column:
        holder, name = self._places[what]
        return F.col(holder)[name].cast("double")

    def rows(self, field: str) -> Column:
        return self._at(field, "docs")

    def mean_length(self, field: str) -> Column:
        return self._at(field, "tokens") / self.rows(field)

    def rows_with(self, field: str, term: str) -> Column:
        return self._at(field, "term", term)


class SeenFigures(CorpusFigures):
    """Corpus figures that are known already, as literals."""

    def __init__(self, values: dict[tuple, int]):
        self.scalars: dict[str, Column] = {}
        self._values = values

    def _at(self, *what: str) -> Column:
        return F.lit(float(self._values[what]))


def phrase_frequency(slots: Column, placed: list[tuple[int, str]]) -> Column:
    first, head = placed[0]

    def at(token: Column, i: Column) -> Column:
        hit = token == head
        for p, t in placed[1:]:
            hit = hit & (F.get(slots, i + (p - first)) == t)
        return F.coalesce(hit, F.lit(False))

    return F.size(F.filter(F.transform(slots, at), lambda hit: hit))


class Scorer:
    """Per-row measures (lengths, frequencies) and the score made from them."""

    def __init__(self, view: TableView, figures: CorpusFigures, rounded: bool):
        self.view, self.figures, self.rounded = view, figures, rounded
        self.measures: dict[str, Column] = {}
        self._names: dict[tuple, str] = {}

    def _measure(self, what: tuple, column: Callable[[], Column]) -> Column:
        if self.view.measured is not None and what in self.view.measured:
            return self.view.measure(*what)
        name = self._names.setdefault(what, f"_m{len(self._names)}")
        self.measures[name] = column()
        return F.col(name)

    def _length(self, field: str) -> Column:
        stored = self.view.measure("length", field)
        if stored is not None:
            return rounded_length(stored) if self.rounded else stored
        length = slot_count(self.view.token_slots(field))
        if self.rounded:
            length = let(length, rounded_length)
        return self._measure(("length", field), lambda: length)

    def score(self, where: Clause) -> Column:
        """Score of a row that matches ``where``."""
        if isinstance(where, And):
            return self.score(where.left) + self.score(where.right)
        if isinstance(where, Or):
            return self._if_matching(where.left) + self._if_matching(where.right)
        terms = _scored_terms(self.view, where)
        if not terms:
            return F.lit(1.0)
        field = terms[0][0]
        rarity = {
            t: idf(self.figures.rows(field), self.figures.rows_with(field, t)) for _, t in terms
        }
        if self.view.spec.field(field).kind is Kind.STRING:
            return rarity[terms[0][1]]
        length, mean = self._length(field), self.figures.mean_length(field)
        if isinstance(where, Phrase):
            # A phrase counts as one term: its occurrences, and its words' rarities added up.
            tf = self._measure(
                ("phrase", field, where.text),
                lambda: phrase_frequency(self.view.token_slots(field), where.positions(self.view)),
            )
            return bm25(tf, length, mean, sum(rarity.values()))
        return sum(
            bm25(self._frequency(field, t), length, mean, r) for t, r in rarity.items()
        )

    def _frequency(self, field: str, term: str) -> Column:
        return self._measure(("tf", field, term), lambda: term_frequency(self.view.token_slots(field), term))

    def _if_matching(self, side: Clause) -> Column:
        matches = self._measure(("matches", id(side)), lambda: side.condition(self.view))
        return F.when(matches, self.score(side)).otherwise(0.0)


def scored(
    view: TableView, where: Clause, rounded: bool = False, figures: CorpusFigures | None = None, matched: bool = False
) -> TableView:
    """Matching rows with their score in ``_score``; ``matched`` says that all rows of the view match."""
    hits = view if matched else matching(view, where)
    figures = figures or CorpusFigures(view, where)
    scorer = Scorer(hits, figures, rounded)
    score = scorer.score(where)
    measures = {**scorer.measures, **figures.scalars}
    df = hits.df.withColumns(measures).withColumn("_score", score).drop(*measures)
    return replace(hits, df=df)
