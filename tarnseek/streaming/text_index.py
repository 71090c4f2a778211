"""Stored postings of a streamed table's TEXT field, brought up to date in steps.

Each update covers the batches committed since the last one and is noted when
wholly written. Only noted updates are read; what an interrupted one has left is
removed by the next. Batches after the last update are searched through their token
arrays, so answers are the same whether or not the index is up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnseek.functions.globs import glob_match
from tarnseek.operators.indexed import PostingsSource
from tarnseek.operators.postings import PostingsTable, TermDictionary, build_postings
from tarnseek.operators.relevance import slot_count
from tarnseek.operators.sorted_postings import sorted_postings
from tarnseek.operators.view import TableView
from tarnseek.schema import ROW_ID
from tarnseek.streaming.feed import TableStore
from tarnseek.streaming.ranges import FAN, Range, Ranges


def _part(merged: Range) -> int:
    """The number of a merged part; updates have those of their batches, which are smaller."""
    return (merged.tier << 40) + merged.upto


class TextIndex:
    def __init__(self, store: TableStore, field: str, buckets: int = 256, salts: int = 16):
        self.store, self.field = store, field
        self._folder = store.folder.child(f"index/{field}")
        self._notes = self._folder.child("updates")
        self.ranges = Ranges(self._folder.child("merges"))
        self._terms = PostingsTable(f"{self._folder.path}/terms", buckets, salts)
        self._dictionary = TermDictionary(f"{self._folder.path}/dictionary")
        self._sizes = f"{self._folder.path}/sizes"

    def noted(self) -> list[int]:
        """The updates that are wholly written, each by its last batch."""
        return sorted(int(n) for n in self._notes.names())

    def covered(self) -> int:
        """The last batch in the index, -1 if there is none."""
        return max(self.noted(), default=-1)

    def live(self) -> list[int]:
        """The parts to read: merged ones, and updates since."""
        ranges = self.ranges.live()
        done = max((r.upto for r in ranges), default=-1)
        return [_part(r) for r in ranges] + [n for n in self.noted() if n > done]

    def _drop_orphans(self) -> None:
        """Remove parts that an update wrote without coming to note them, and those that have been merged."""
        live = {f"_upto={n}" for n in self.live()}
        self.ranges.forget()
        for name in ("terms", "dictionary", "sizes"):
            folder = self._folder.child(name)
            for part in folder.names():
                if part.startswith("_upto=") and part not in live:
                    folder.child(part).remove()

    def merge(self, updates: int = FAN, fan: int = FAN) -> int:
        """Rewrite the parts of updates to one, once there are so many, and parts of a tier to one of the next; returns the parts left.

        What is replaced is removed by the next update or merge.
        """
        self._drop_orphans()
        done, noted = self.ranges.covered(), self.noted()
        fresh = [n for n in noted if n > done]
        if len(fresh) >= updates:
            self._rewrite(Range(1, done, fresh[-1]), fresh)
        while ranges := self.ranges.to_merge(fan):
            self._rewrite(Range(ranges[0].tier + 1, ranges[0].after, ranges[-1].upto), [_part(r) for r in ranges])
        return len(self.live())

    def _rewrite(self, new: Range, parts: list[int]) -> None:
        spark, part = self.store.spark, f"_upto={_part(new)}"
        self._terms.write(self._terms.read(spark).where(F.col("_upto").isin(parts)).drop("_upto"), ROW_ID, part)
        self._dictionary.write(self._terms.part(spark, part), part)
        sizes = spark.read.option("basePath", self._sizes).parquet(self._sizes).where(F.col("_upto").isin(parts)).drop("_upto")
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{self._sizes}/{part}")
        self.ranges.note(new)

    def update(self) -> int:
        """Index the batches committed since the last update (one updater at a time)."""
        done, latest = self.covered(), self.store.snapshots.latest()
        self._drop_orphans()
        if latest > done:
            view = self._view(done, latest)
            part = f"_upto={latest}"
            self._terms.write(sorted_postings(view, self.field), ROW_ID, part)
            self._dictionary.write(self._terms.part(self.store.spark, part), part)
            self._batch_sizes(view).write.mode("overwrite").parquet(f"{self._sizes}/{part}")
            self._notes.put_new(str(latest))
        return latest

    def _view(self, after: int, up_to: int) -> TableView:
        rows = self.store.rows(up_to).where(F.col("_batch_id") > after)
        return TableView(rows, self.store.spec, ROW_ID)

    def _batch_sizes(self, view: TableView) -> DataFrame:
        length = slot_count(view.token_slots(self.field)).alias("n")
        counted = view.df.select("_batch_id", length)
        sums = [F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("tokens")]
        return counted.groupBy("_batch_id").agg(*sums)

    def source(self, up_to: int) -> PostingsSource:
        return _Snapshot(self, up_to)


class _Snapshot(PostingsSource):
    """The index as of one snapshot, with later batches added from their tokens."""

    def __init__(self, index: TextIndex, up_to: int):
        self._index, self._up_to = index, up_to
        self._covered = min(index.covered(), up_to)
        self._noted = index.live()

    def _stored(self, df: DataFrame) -> DataFrame:
        # Only noted updates, only rows of the snapshot.
        return df.where(F.col("_upto").isin(self._noted) & (F.col("_batch_id") <= self._up_to))

    def postings(self, terms):
        stored = self._stored(self._index._terms.read(self._index.store.spark, terms)).drop("_upto")
        if self._covered >= self._up_to:
            return stored
        fresh = self._index._view(self._covered, self._up_to)
        return stored.unionByName(build_postings(fresh, self._index.field, terms=terms))

    def postings_like(self, glob):
        """A glob picks terms of the dictionary, and the terms pick buckets of the postings."""
        spark, index = self._index.store.spark, self._index
        parts = {f"_upto={n}" for n in self._noted}
        if not parts or not parts <= set(index._folder.child("dictionary").names()):
            # An index of before there was a dictionary.
            return super().postings_like(glob)
        terms = index._dictionary.like(spark, glob).where(F.col("_upto").isin(self._noted)).select("term", "bucket").distinct()
        stored = self._stored(index._terms.read_terms(spark, terms)).drop("_upto")
        if self._covered >= self._up_to:
            return stored
        fresh = build_postings(index._view(self._covered, self._up_to), index.field)
        return stored.unionByName(fresh.where(glob_match(F.col("term"), glob)))

    def sizes(self):
        spark, path = self._index.store.spark, self._index._sizes
        stored = self._stored(spark.read.option("basePath", path).parquet(path)).select("docs", "tokens")
        if self._covered >= self._up_to:
            return stored
        fresh = self._index._batch_sizes(self._index._view(self._covered, self._up_to))
        return stored.union(fresh.select("docs", "tokens"))
