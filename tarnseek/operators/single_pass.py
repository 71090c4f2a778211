"""Hits, total and corpus figures of a search from one pass over the table.

Every row is tokenised once. Figures of the whole table and the number of hits are observed on the way, and the
hits are written as narrow rows: what was asked for, fields that can be sorted by, and the measures that scores are made of. Sorting, scoring
and paging then read those alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tarnseek.functions.globs import glob_match
from tarnseek.operators.clauses import Clause, has_slot, matching
from tarnseek.operators.indexed import token_measures
from tarnseek.operators.relevance import CorpusFigures, SeenFigures, phrase_frequency, slot_count, term_frequency
from tarnseek.operators.view import TableView
from tarnseek.schema import Kind
from tarnseek.sources.storage import work_folder


def _measure(view: TableView, what: tuple, by: object) -> Column:
    """What a row has of a measure, from its tokens."""
    slots = view.token_slots(what[1])
    if what[0] == "length":
        return slot_count(slots)
    if what[0] == "tf":
        return term_frequency(slots, by)
    if what[0] == "phrase":
        return phrase_frequency(slots, by) if by else F.lit(0)
    return F.exists(slots, lambda token: F.coalesce(glob_match(token, by), F.lit(False))).cast("int")


def _has(view: TableView, field: str, term: str) -> Column:
    return has_slot(view.token_slots(field), term) if view.spec.field(field).kind is Kind.TEXT else F.col(field) == term


def _narrow(view: TableView, keep: Iterable[str]) -> list[str]:
    """Columns that hits are written with: those asked for, and all but texts and their tokens."""
    texts = {c for f in view.spec.fields if f.kind is Kind.TEXT for c in (f.name, f.token_column)} | {"_value"}
    return [c for c in view.df.columns if c in keep or c not in texts]


def _written(view: TableView, df: DataFrame, counts: dict[tuple, Column], seen: Observation) -> tuple[DataFrame, dict[tuple, int]]:
    names = {what: f"f{i}" for i, what in enumerate(counts)}
    path = work_folder(df.sparkSession, "hits")
    hits = df.observe(seen, *[c.alias(names[what]) for what, c in counts.items()])
    if "_hit" in df.columns:
        hits = hits.where(F.col("_hit")).drop("_hit", *[c for c in df.columns if c.startswith("_h")])
    hits.write.parquet(path)
    values = {what: seen.get[n] or 0 for what, n in names.items()}
    return df.sparkSession.read.schema(hits.schema).parquet(path), values


def hits_once(view: TableView, where: Clause, keep: Iterable[str], ranked: bool) -> tuple[TableView, SeenFigures | None, int]:
    """The hits as a view of written rows, figures to score them by (if ``ranked``), and how many they are.

    The view's rows have matched already. Its table lies in the session's shared folder.
    """
    keep = set(keep)
    if not ranked:
        hits = matching(view, where)
        df, values = _written(view, hits.df.select(*_narrow(view, keep)), {("total",): F.count(F.lit(1))}, Observation())
        return replace(view, df=df), None, values["total",]
    whole = view.with_tokens(*where.text_fields(view))
    wanted = {what: by for field in token_measures(whole, where).values() for what, by in field.items()}
    names = {what: f"_x{i}" for i, what in enumerate(wanted)}
    columns = [_measure(whole, what, by).alias(names[what]) for what, by in wanted.items()]
    narrow = _narrow(view, keep)
    # Words of a phrase have a rarity but no measure of their own.
    terms_of = CorpusFigures.terms_of(view, where)
    other = {(f, t): f"_h{f}_{i}" for f, terms in terms_of.items() for i, t in enumerate(terms) if ("tf", f, t) not in names}
    has = [_has(whole, f, t).alias(name) for (f, t), name in other.items()]
    measured = replace(whole, df=whole.df.select(*narrow, *columns, *has), measured=names)
    rows = measured.df.withColumn("_hit", F.coalesce(where.condition(measured), F.lit(False)))
    counts: dict[tuple, Column] = {("total",): F.count_if("_hit")}
    for field, terms in terms_of.items():
        is_text = view.spec.field(field).kind is Kind.TEXT
        length = F.col(names["length", field]) if is_text else F.col(field).isNotNull().cast("int")
        counts[field, "docs"], counts[field, "tokens"] = F.count_if(length > 0), F.sum(length)
        for t in terms:
            held = F.col(other[field, t]) if (field, t) in other else F.col(names["tf", field, t]) > 0
            counts[field, "term", t] = F.count_if(held)
    df, values = _written(view, rows, counts, Observation())
    return replace(view, df=df, measured=names), SeenFigures(values), values["total",]
