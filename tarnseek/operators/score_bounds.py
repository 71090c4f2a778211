"""The best page of a ranked search without scoring every hit.

A row's score is the sum of what its terms give. The best postings of each term show what a term can give at most, and what
the last row of the page has at least. Terms that can't lift a row to the page, not even all together, are left out when
rows are looked for; of the others, only postings count that could reach the page with the most that the rest can give. The
rows found so keep all their postings, and are joined to the table and scored as ever. All other hits score less than the page's
last row, so the page is that of the full ranking.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tarnseek.operators.clauses import Clause, Equals, MatchAny, Or
from tarnseek.operators.indexed import PostingsSource
from tarnseek.operators.ordering import is_deep
from tarnseek.operators.relevance import SeenFigures, bm25, idf, rounded_length
from tarnseek.operators.view import TableView
from tarnseek.schema import Kind
from tarnseek.sources.storage import work_folder

#: Share of a score by which sums of the same parts may differ.
_SLACK = 1e-9


def summed_terms(view: TableView, where: Clause) -> tuple[str, dict[str, int]] | None:
    """The TEXT field and how often each term counts, if scores are nothing but sums over the terms of one field."""
    if isinstance(where, Or):
        sides = [summed_terms(view, side) for side in (where.left, where.right)]
        if None in sides or sides[0][0] != sides[1][0]:
            return None
        return sides[0][0], dict(Counter(sides[0][1]) + Counter(sides[1][1]))
    if isinstance(where, MatchAny):
        terms = list(where.terms(view))
    elif isinstance(where, Equals) and view.spec.field(where.field).kind is Kind.TEXT:
        terms = [where.value]
    else:
        return None
    return (where.field, dict.fromkeys(terms, 1)) if terms else None


@dataclass(frozen=True)
class Bounds:
    """What each term gives a row at most, and what a row needs for the page."""

    most: Mapping[str, float]
    needed: float

    def searched(self) -> list[str]:
        """The terms by which rows are looked for. Rows that hold only others can't reach the page."""
        idle, upto = set(), 0.0
        for term in sorted(self.most, key=lambda t: (self.most[t], t)):
            upto += self.most[term]
            if upto >= self.needed:
                break
            idle.add(term)
        return [t for t in self.most if t not in idle]

    def least(self, term: str) -> float:
        """What a posting of the term must give, if the row has the most of all others."""
        return self.needed - sum(most for t, most in self.most.items() if t != term)

    def prune(self) -> bool:
        return len(self.searched()) < len(self.most) or any(self.least(t) > 0 for t in self.most)


class BoundedSource(PostingsSource):
    """The postings of some rows of an index."""

    def __init__(self, source: PostingsSource, rows: DataFrame):
        self._source, self._rows = source, rows

    def postings(self, terms):
        return self._source.postings(terms).join(self._rows, self._rows.columns, "left_semi")

    def sizes(self):
        return self._source.sizes()


class _Parts:
    """Postings of one field with what each gives to the score of its row."""

    def __init__(self, source: PostingsSource, field: str, weights: Mapping[str, int], rounded: bool):
        self.source, self.field, self.weights, self.rounded = source, field, weights, rounded
        size = source.sizes().agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).first()
        counts = source.postings(list(weights)).groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
        rows_with = {r["term"]: r["rows"] for r in counts.collect()}
        self.figures = SeenFigures(
            {(field, "docs"): size["docs"] or 0, (field, "tokens"): size["tokens"] or 0}
            | {(field, "term", t): rows_with.get(t, 0) for t in weights}
        )

    def of(self, terms: list[str]) -> DataFrame:
        """The postings of these terms with their ``part``."""
        length = rounded_length(F.col("length")) if self.rounded else F.col("length")
        part: Column = F.lit(None).cast("double")
        for t in terms:
            rarity = idf(self.figures.rows(self.field), self.figures.rows_with(self.field, t))
            given = self.weights[t] * bm25(F.col("tf"), length, self.figures.mean_length(self.field), rarity)
            part = F.when(F.col("term") == t, given).otherwise(part)
        return self.source.postings(terms).withColumn("part", part)

    def bounds(self, k: int) -> Bounds:
        """From the ``k`` best postings of each term: a heap per task and term, no sort of all."""
        best = [
            self.of([t]).select("part").orderBy(F.desc("part")).limit(k)
            .agg(F.lit(t).alias("term"), F.max("part").alias("most"), F.min("part").alias("last"), F.count(F.lit(1)).alias("rows"))
            for t in self.weights
        ]
        found = reduce(lambda a, b: a.unionByName(b), best).collect()
        needed = max((r["last"] for r in found if r["rows"] == k), default=0.0)
        return Bounds({r["term"]: r["most"] or 0.0 for r in found}, needed * (1 - _SLACK))


def bounded(
    view: TableView, where: Clause, sources: Mapping[str, PostingsSource], k: int, rounded: bool = False
) -> tuple[dict[str, PostingsSource], SeenFigures] | None:
    """Sources that give only the postings of rows that can be among the best ``k``, and the figures to score them by.

    None if scores aren't sums over terms of one field, or the page lies far in; such a search is ranked in full. The rows found are written
    to the session's shared folder, so the planner knows their size when it joins them to the postings. The index is read
    at once, four times at most: batches that it doesn't cover are tokenised each time. Figures and bounds of each term
    come to the driver, nothing else. Of each term the ``k`` best postings pass through one task, as for the page itself.
    """
    summed = summed_terms(view, where)
    if summed is None or is_deep(0, k):
        return None
    field, weights = summed
    parts = _Parts(sources[field], field, weights, rounded)
    bounds = parts.bounds(k)
    if not bounds.prune():
        return dict(sources), parts.figures
    searched = bounds.searched()
    enough = F.lit(False)
    for t in searched:
        enough = F.when(F.col("term") == t, F.col("part") >= bounds.least(t)).otherwise(enough)
    rows = parts.of(searched).where(enough).select(*view.tie)
    path = work_folder(rows.sparkSession, "reach")
    rows.write.parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return {**sources, field: BoundedSource(sources[field], rows)}, parts.figures
