"""Predicates on typed fields, combined with ``&`` and ``|``.

A clause is checked against the table spec and becomes one native boolean
Column. Comparisons on typed columns reach the parquet scan; token tests read
the token array of a TEXT field. Where no token array is stored, rows first
pass the plain tests every match must pass, and only the rest is tokenised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from tarnseek.errors import TarnseekError
from tarnseek.functions.columns import let
from tarnseek.functions.dates import date_literal
from tarnseek.functions.globs import glob_match, literal_runs
from tarnseek.operators.ordering import plain_literal
from tarnseek.operators.view import TableView
from tarnseek.schema import Field, Kind


class Clause:
    def __and__(self, other: Clause) -> Clause:
        return And(self, other)

    def __or__(self, other: Clause) -> Clause:
        return Or(self, other)

    def condition(self, view: TableView) -> Column:
        """The exact test; TEXT fields must have a token column in the view."""
        raise NotImplementedError

    def necessary(self, view: TableView) -> Column:
        """A test without tokens that every match passes."""
        return self.condition(view)

    def leaves(self) -> Iterator[Clause]:
        yield self

    def text_fields(self, view: TableView) -> list[str]:
        """TEXT fields whose tokens the clause reads."""
        names = [
            leaf.field
            for leaf in self.leaves()
            if isinstance(leaf, (Equals, Like, _Analyzed)) and view.spec.field(leaf.field).kind is Kind.TEXT
        ]
        return list(dict.fromkeys(names))


def number_or_date_literal(field: Field, value: object) -> Column:
    """The literal of a comparison, checked against the field's type."""
    if field.kind is Kind.DATE:
        return plain_literal(date_literal(value, field.pattern))
    if not field.kind.is_number:
        raise TarnseekError(f"column[{field.name}] of type {field.kind.value} has no range")
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TarnseekError(f"column[{field.name}]: [{value!r}] is not a number")
    if isinstance(value, int) and not -(2**63) <= value < 2**63:
        raise TarnseekError(f"column[{field.name}]: [{value}] does not fit a long")
    return F.lit(value)


def exact_literal(field: Field, value: object) -> Column:
    if field.kind in (Kind.STRING, Kind.TEXT):
        if not isinstance(value, str):
            raise TarnseekError(f"column[{field.name}]: [{value!r}] is not text")
        return F.lit(value)
    return number_or_date_literal(field, value)


def has_slot(slots: Column, token: str) -> Column:
    """Does a token array hold this token? Stop-word slots are NULL and never match."""
    return F.coalesce(F.array_contains(slots, token), F.lit(False))


def text_holds(view: TableView, name: str, pieces: list[str], how=and_) -> Column:
    """Test the folded text for plain stretches: a token is always one of the text's, unless the analyzer makes others."""
    if not view.spec.analyzer.stands_in_text:
        return F.lit(True)
    folded = view.spec.analyzer.fold(F.col(name))
    tests = [F.contains(folded, F.lit(p)) for p in pieces if p]
    return reduce(how, tests) if tests else F.lit(True)


@dataclass(frozen=True)
class Everything(Clause):
    def condition(self, view):
        return F.lit(True)


@dataclass(frozen=True)
class Equals(Clause):
    """Whole-value equality; on TEXT: the text has exactly this token (not analysed)."""

    field: str
    value: object

    def condition(self, view):
        field = view.spec.field(self.field)
        literal = exact_literal(field, self.value)
        if field.kind is not Kind.TEXT:
            return F.col(self.field) == literal
        times = view.measure("tf", self.field, self.value)
        return has_slot(view.token_slots(self.field), self.value) if times is None else times > 0

    def necessary(self, view):
        if view.spec.field(self.field).kind is Kind.TEXT:
            return text_holds(view, self.field, [self.value])
        return self.condition(view)


@dataclass(frozen=True)
class Compare(Clause):
    field: str
    op: str
    value: object

    def condition(self, view):
        field = view.spec.field(self.field)
        literal = number_or_date_literal(field, self.value)
        column = F.col(self.field)
        try:
            return {
                ">": column > literal,
                ">=": column >= literal,
                "<": column < literal,
                "<=": column <= literal,
            }[self.op]
        except KeyError:
            raise TarnseekError(f"operator[{self.op}] is not supported") from None


@dataclass(frozen=True)
class Between(Clause):
    """Both ends included; the ends must be in order."""

    field: str
    low: object
    high: object

    def condition(self, view):
        field = view.spec.field(self.field)
        low = number_or_date_literal(field, self.low)
        high = number_or_date_literal(field, self.high)
        ends = (self.low, self.high)
        if field.kind is Kind.DATE:
            ends = tuple(date_literal(v, field.pattern) for v in ends)
        if ends[0] > ends[1]:
            raise TarnseekError(f"column[{self.field}]: the start is greater than the end")
        return F.col(self.field).between(low, high)


@dataclass(frozen=True)
class Like(Clause):
    """Glob match of the whole STRING, or of any one token of a TEXT."""

    field: str
    glob: str

    def condition(self, view):
        field = view.spec.field(self.field)
        if field.kind is Kind.STRING:
            return glob_match(F.col(self.field), self.glob)
        if field.kind is not Kind.TEXT:
            raise TarnseekError(f"column[{self.field}] of type {field.kind.value} has no wildcard match")
        times = view.measure("glob", self.field, self.glob)
        if times is not None:
            return times > 0
        return F.exists(
            view.token_slots(self.field),
            lambda token: F.coalesce(glob_match(token, self.glob), F.lit(False)),
        )

    def necessary(self, view):
        if view.spec.field(self.field).kind is Kind.TEXT:
            return text_holds(view, self.field, literal_runs(self.glob))
        return self.condition(view)


@dataclass(frozen=True)
class HasField(Clause):
    """The record has the field."""

    field: str

    def condition(self, view):
        view.spec.field(self.field)
        return F.col(self.field).isNotNull()


@dataclass(frozen=True)
class _Analyzed(Clause):
    """Clauses whose literal goes through the table's analyzer."""

    field: str
    text: str

    def positions(self, view: TableView) -> list[tuple[int, str]]:
        view.text_field(self.field)
        return view.spec.analyzer.analyze_literal(view.df.sparkSession, self.text)

    def terms(self, view: TableView) -> list[str]:
        return list(dict.fromkeys(term for _, term in self.positions(view)))

    def necessary(self, view):
        return text_holds(view, self.field, self.terms(view))


@dataclass(frozen=True)
class MatchAll(_Analyzed):
    """The text holds every token of the analysed literal; none at all matches nothing."""

    def condition(self, view):
        terms = self.terms(view)
        if not terms:
            return F.lit(False)
        if view.measured is not None:
            return reduce(and_, [view.measure("tf", self.field, t) > 0 for t in terms])
        shared = F.array_intersect(view.token_slots(self.field), F.array(*map(F.lit, terms)))
        return F.size(shared) == len(terms)


@dataclass(frozen=True)
class MatchAny(_Analyzed):
    """The text holds at least one token of the analysed literal."""

    def condition(self, view):
        terms = self.terms(view)
        if not terms:
            return F.lit(False)
        if view.measured is not None:
            return reduce(or_, [view.measure("tf", self.field, t) > 0 for t in terms])
        overlap = F.arrays_overlap(view.token_slots(self.field), F.array(*map(F.lit, terms)))
        return F.coalesce(overlap, F.lit(False))

    def necessary(self, view):
        return text_holds(view, self.field, self.terms(view), how=or_)


@dataclass(frozen=True)
class Phrase(_Analyzed):
    """The tokens of the analysed literal stand in the text at the same distances."""

    def condition(self, view):
        placed = self.positions(view)
        if not placed:
            return F.lit(False)
        times = view.measure("phrase", self.field, self.text)
        if times is not None:
            return times > 0
        first, head = placed[0]

        def stands(slots: Column) -> Column:
            def at(token: Column, i: Column) -> Column:
                rest = [F.get(slots, i + (p - first)) == t for p, t in placed[1:]]
                return F.coalesce(reduce(and_, rest, token == head), F.lit(False))

            return F.exists(F.transform(slots, at), lambda hit: hit)

        return let(view.token_slots(self.field), stands)


@dataclass(frozen=True)
class And(Clause):
    left: Clause
    right: Clause

    def condition(self, view):
        return self.left.condition(view) & self.right.condition(view)

    def necessary(self, view):
        return self.left.necessary(view) & self.right.necessary(view)

    def leaves(self):
        yield from self.left.leaves()
        yield from self.right.leaves()


@dataclass(frozen=True)
class Or(Clause):
    left: Clause
    right: Clause

    def condition(self, view):
        return self.left.condition(view) | self.right.condition(view)

    def necessary(self, view):
        return self.left.necessary(view) | self.right.necessary(view)

    def leaves(self):
        yield from self.left.leaves()
        yield from self.right.leaves()


def matching(view: TableView, where: Clause | None) -> TableView:
    """Rows that satisfy the clause; no clause keeps all."""
    if where is None or isinstance(where, Everything):
        return view
    reads = [] if view.measured is not None else where.text_fields(view)
    if any(not view.has_token_column(view.spec.field(f)) for f in reads):
        view = view.where(where.necessary(view)).with_tokens(*reads)
    return view.where(where.condition(view))
