"""The stream that fills a table: records → typed rows → appended parquet.

Every micro-batch is written into its own ``_batch_id`` folder and then noted
as committed. A batch replayed after a crash overwrites its folder or, if it
was committed, is skipped, so each record lands exactly once.
"""

from __future__ import annotations

import threading
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnseek.errors import TarnseekError
from tarnseek.schema import TableSpec
from tarnseek.sources.decode import BAD, OK, decode_records
from tarnseek.sources.records import ARRIVED
from tarnseek.sources.storage import Folder
from tarnseek.streaming.progress import IDLE_NOTE_MS, IDLE_NOTES, progress_of
from tarnseek.streaming.ranges import FAN, Range, Ranges
from tarnseek.streaming.snapshots import SnapshotLog

REFRESH = "1 second"


class TableStore:
    """Files of one table: ``data/_batch_id=…/_status=…``, rewritten ranges, commits, tokens and checkpoint."""

    def __init__(self, spark: SparkSession, path: str, spec: TableSpec, token_lifetime: float = 0):
        self.spark = spark
        self.spec = spec
        self.folder = Folder(spark, path)
        self.snapshots = SnapshotLog(self.folder, token_lifetime)
        self._data = f"{self.folder.path}/data"
        self._compact = f"{self.folder.path}/compact"
        self.ranges = Ranges(self.folder.child("ranges"))

    def append(self, records: DataFrame, batch: int, on_bad_value: str = "quarantine") -> float | None:
        """Write one batch and commit it; a committed batch isn't written again. Gives the time of its oldest file, if records have it."""
        if self.snapshots.is_committed(batch):
            return None
        oldest = Observation()
        if ARRIVED in records.columns:
            records = records.observe(oldest, F.min(F.unix_micros(ARRIVED)).alias("at"))
        rows = decode_records(records, self.spec, on_bad_value)
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy("_status").parquet(f"{self._data}/_batch_id={batch}")
        self.snapshots.commit(batch)
        at = oldest.get["at"] if ARRIVED in records.columns else None
        return None if at is None else at / 1e6

    def start(
        self,
        records: DataFrame,
        query_name: str,
        refresh: str | None = REFRESH,
        on_bad_value: str = "quarantine",
    ) -> StreamingQuery:
        """Run the stream; ``refresh=None`` takes what is there and ends."""
        if self.snapshots.latest() >= 0 and not self.folder.exists("checkpoint"):
            # A new checkpoint counts batches from 0, and those are committed already.
            raise TarnseekError(f"table[{self.spec.name}] has rows but its checkpoint is gone, drop it first")
        progress, run = progress_of(self.spark), []

        def take(df: DataFrame, batch: int) -> None:
            oldest = self.append(df, batch, on_bad_value)
            started.wait()
            progress.committed(run[0], oldest)

        started = threading.Event()
        writer = (
            records.writeStream.queryName(query_name)
            .option("checkpointLocation", f"{self.folder.path}/checkpoint")
            .foreachBatch(take)
        )
        how = {"availableNow": True} if refresh is None else {"processingTime": refresh}
        # The stream has its own copy of the settings from here on.
        usual = self.spark.conf.get(IDLE_NOTES, None)
        self.spark.conf.set(IDLE_NOTES, IDLE_NOTE_MS)
        try:
            query = writer.trigger(**how).start()
        finally:
            self.spark.conf.unset(IDLE_NOTES) if usual is None else self.spark.conf.set(IDLE_NOTES, usual)
        if ARRIVED not in records.columns:
            progress.takes_all(query)
        run.append(str(query.runId))
        started.set()
        return query

    def rows(self, up_to: int | None = None) -> DataFrame:
        """Usable rows of the committed batches, up to a snapshot."""
        return self._read(up_to, OK).drop("_error", "_status")

    def quarantine(self, up_to: int | None = None) -> DataFrame:
        """Records that couldn't be used, with the reason."""
        return self._read(up_to, BAD).select("_name", "_key", "_value", "_error", "_batch_id")

    def _read(self, up_to: int | None, status: str) -> DataFrame:
        batch = self.snapshots.latest() if up_to is None else up_to
        rows = self._stored(self.ranges.live(), batch)
        return rows.where((F.col("_batch_id") <= batch) & (F.col("_status") == status))

    def _stored(self, ranges: list[Range], upto: int) -> DataFrame:
        """Rows of the rewritten ranges, and those of later batches from their own folders."""
        schema = self.spec.stored_struct()
        read, found = self.spark.read.schema(schema), []
        done = max((r.upto for r in ranges), default=-1)
        if upto > done and self.folder.exists("data"):
            later = read.option("basePath", self._data).parquet(self._data)
            found.append(later.where(F.col("_batch_id") > done) if ranges else later)
        paths = [f"{self._compact}/_range={r.name}" for r in ranges if r.after < upto]
        if paths:
            found.append(read.option("basePath", self._compact).parquet(*paths).select(*schema.names))
        if not found or upto < 0:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, found)

    def compact(self, batches: int = 100, fan: int = FAN) -> int:
        """Rewrite committed batches to large files, once there are ``batches`` that haven't been; returns the last batch rewritten.

        Rows keep their batch and row numbers, so tokens and indexes stay valid, also those of before. A range counts when it is noted
        as wholly written; the folders it replaces are removed by the next call, so that reads planned before can end.
        Streaming and reading go on meanwhile; one compaction at a time.
        """
        latest, done = self.snapshots.latest(), self.ranges.covered()
        self._drop_replaced(done)
        if latest - done >= batches:
            self._rewrite(Range(1, done, latest), self._stored([], latest).where(F.col("_batch_id").between(done + 1, latest)))
        while ranges := self.ranges.to_merge(fan):
            self._rewrite(Range(ranges[0].tier + 1, ranges[0].after, ranges[-1].upto), self._stored(ranges, ranges[-1].upto))
        return self.ranges.covered()

    def _rewrite(self, new: Range, rows: DataFrame) -> None:
        dealt = rows.hint("rebalance", "_status").sortWithinPartitions("_status", "_batch_id", "_row")
        writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy("_status").parquet(f"{self._compact}/_range={new.name}")
        self.ranges.note(new)

    def _drop_replaced(self, done: int) -> None:
        """Remove what ranges noted before have replaced, and what an interrupted rewriting has left."""
        live = {f"_range={r.name}" for r in self.ranges.live()}
        self.ranges.forget()
        for name in self.folder.child("compact").names():
            if name not in live:
                self.folder.child("compact").child(name).remove()
        for name in self.folder.child("data").names():
            if name.startswith("_batch_id=") and int(name.removeprefix("_batch_id=")) <= done:
                self.folder.child("data").child(name).remove()
