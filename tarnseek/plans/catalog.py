"""The catalog of streaming tables under one root folder."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnseek.errors import TarnseekError
from tarnseek.functions.analyzers import Tokenizing, analyzer_named
from tarnseek.operators.clauses import Clause
from tarnseek.operators.view import TableView
from tarnseek.plans.search import SearchResult, search_view
from tarnseek.schema import ROW_ID, Field, Kind, RecordSource, TableSpec
from tarnseek.sources.records import ARRIVED, FILE_AGE, FILES_PER_BATCH, current_records, stream_records
from tarnseek.sources.storage import Folder
from tarnseek.streaming.feed import REFRESH, TableStore
from tarnseek.streaming.progress import progress_of
from tarnseek.streaming.snapshots import NO_TOKEN
from tarnseek.streaming.text_index import TextIndex

SPEC_FILE = "spec.json"
WAIT_SECONDS = 60.0


class Catalog:
    """Create, list, start, stop, search and drop tables.

    ``search_expired`` is how many seconds a snapshot token lives; 0 turns
    tokens off.
    """

    def __init__(self, spark: SparkSession, root: str, search_expired: float = 0):
        self.spark = spark
        self.root = Folder(spark, root)
        self.search_expired = search_expired

    # --- definitions ----------------------------------------------------------
    def create_table(
        self,
        name: str,
        fields: Sequence[Field | tuple],
        source: RecordSource,
        analyzer: str | Tokenizing = "standard",
        start: bool = True,
        **start_options,
    ) -> TableSpec:
        """Define a table and, unless told otherwise, start filling it.

        The source is checked before anything is stored.
        """
        fields = [f if isinstance(f, Field) else Field(*f) for f in fields]
        if isinstance(analyzer, str):
            analyzer = analyzer_named(analyzer)
        spec = TableSpec(name, tuple(fields), source, analyzer)
        if not Folder(self.spark, source.path).exists():
            raise TarnseekError(f"source path [{source.path}] doesn't exist")
        if not self.root.child(name).put_new(SPEC_FILE, spec.to_json()):
            raise TarnseekError(f"table[{name}] exists already")
        if start:
            self.start(name, **start_options)
        return spec

    def describe(self, name: str) -> TableSpec:
        if not self.root.child(name).exists(SPEC_FILE):
            raise TarnseekError(f"table[{name}] doesn't exist")
        return TableSpec.from_json(self.root.child(name).text(SPEC_FILE))

    def tables(self) -> DataFrame:
        """Name, source and whether it's running, one row per table."""
        schema = "name string, source_path string, source_name string, running boolean"
        names = [n for n in self.root.names() if self.root.child(n).exists(SPEC_FILE)]
        if not names:
            return self.spark.createDataFrame([], schema)
        specs = self.spark.read.schema("name string, source struct<path:string,name:string>").json(
            [f"{self.root.path}/{n}/{SPEC_FILE}" for n in names]
        )
        running = [n for n in names if self.is_running(n)]
        return specs.select(
            "name",
            F.col("source.path").alias("source_path"),
            F.col("source.name").alias("source_name"),
            F.col("name").isin(running).alias("running") if running else F.lit(False).alias("running"),
        )

    def drop(self, name: str) -> None:
        """Delete a stopped table: rows, checkpoint, tokens and definition."""
        self.describe(name)
        if self.is_running(name):
            raise TarnseekError(f"table[{name}] is running")
        self.root.child(name).remove()

    # --- filling ----------------------------------------------------------------
    def store(self, name: str) -> TableStore:
        spec = self.describe(name)
        return TableStore(self.spark, f"{self.root.path}/{name}", spec, self.search_expired)

    def _query_name(self, name: str) -> str:
        return f"{self.root.path}/{name}"

    def running_query(self, name: str) -> StreamingQuery | None:
        for query in self.spark.streams.active:
            if query.name == self._query_name(name):
                return query
        return None

    def is_running(self, name: str) -> bool:
        return self.running_query(name) is not None

    def start(
        self,
        name: str,
        refresh: str | None = REFRESH,
        files_per_batch: int = FILES_PER_BATCH,
        on_bad_value: str = "quarantine",
        file_age: str = FILE_AGE,
    ) -> StreamingQuery:
        """Fill the table from where its checkpoint stands (see ``stream_records`` for the limits)."""
        store = self.store(name)
        if self.is_running(name):
            raise TarnseekError(f"table[{name}] is running already")
        records = stream_records(self.spark, store.spec.source, files_per_batch, file_age)
        return store.start(records, self._query_name(name), refresh, on_bad_value)

    def stop(self, name: str, wait_seconds: float = WAIT_SECONDS) -> None:
        """Write what has arrived by now, then stop; what arrives meanwhile is left for the next start."""
        query = self.running_query(name)
        if query is None:
            raise TarnseekError(f"table[{name}] is not running")
        try:
            self.wait_for_arrived(name, wait_seconds)
        finally:
            query.stop()

    def wait_for_arrived(self, name: str, seconds: float = WAIT_SECONDS) -> int:
        """Wait until what has arrived at the source by now is committed; returns the last committed batch.

        Goes by the stream's own events, so it costs the driver the same however many files there are, and it also ends while
        a source keeps growing. Files must show their time of arrival, or an earlier one. Raises
        after ``seconds``, or if the stream has failed.
        """
        store, query = self.store(name), self.running_query(name)
        now, file_time = time.time(), store.folder.now()
        in_time = query is not None and progress_of(self.spark).wait(query, now, file_time, seconds)
        if query is None or query.exception() is not None or not query.isActive:
            raise TarnseekError(f"table[{name}] has stopped: {query and query.exception()}")
        if not in_time:
            raise TarnseekError(f"table[{name}]: rows that had arrived weren't written within {seconds} s")
        return store.snapshots.latest()

    def index_text(self, name: str, field: str, buckets: int = 256) -> int:
        """Store postings of a TEXT field, or bring them up to date; returns the last batch covered.

        Searches then read the postings of their terms instead of all token arrays.
        """
        store = self.store(name)
        if store.spec.field(field).kind is not Kind.TEXT:
            raise TarnseekError(f"column[{field}] is not a text column")
        folder = store.folder.child(f"index/{field}")
        folder.put_new("buckets", str(buckets))
        return TextIndex(store, field, int(folder.text("buckets"))).update()

    def compact(self, name: str, batches: int = 100) -> int:
        """Rewrite a table's small batches, and the parts of its text indexes, to large files; tokens stay valid.

        Returns the last batch rewritten (see ``TableStore.compact``). The table may be running.
        """
        store = self.store(name)
        for field in store.spec.fields:
            folder = store.folder.child(f"index/{field.name}")
            if folder.exists("updates"):
                TextIndex(store, field.name, int(folder.text("buckets"))).merge()
        return store.compact(batches)

    def _indexes(self, store: TableStore, where: Clause | None, view: TableView, up_to: int) -> dict:
        found = {}
        for field in where.text_fields(view) if where is not None else ():
            folder = store.folder.child(f"index/{field}")
            if folder.exists("updates"):
                index = TextIndex(store, field, int(folder.text("buckets")))
                found[field] = index.source(up_to)
        return found

    # --- reading ----------------------------------------------------------------
    def view(self, name: str, up_to: int | None = None) -> TableView:
        store = self.store(name)
        return TableView(store.rows(up_to), store.spec, ROW_ID)

    def search(
        self,
        name: str,
        where: Clause | None = None,
        select: Sequence[str] | None = None,
        token: int = NO_TOKEN,
        wait: bool = False,
        wait_seconds: float = WAIT_SECONDS,
        fresh: bool = False,
        **options,
    ) -> SearchResult:
        """Search a table (see ``search_view`` for the options).

        A running table gives a snapshot token with the result; passing it back
        pages through the same rows. ``wait`` makes rows that have arrived at
        the source by now visible first, within ``wait_seconds``. ``fresh`` reads the values of the page from the
        table's own source as they are there now: of several records under a key that of the newest file; hits whose record is
        gone are left out of the rows.
        """
        store = self.store(name)
        if fresh:
            options |= {"records": current_records(self.spark, store.spec.source), "version": ARRIVED}
        query = self.running_query(name)
        snapshot = None
        up_to = None
        if query is not None:
            if token >= 0:
                up_to = snapshot = store.snapshots.acquire(token)
            else:
                if wait:
                    self.wait_for_arrived(name, wait_seconds)
                up_to, snapshot = store.snapshots.record()
        up_to = store.snapshots.latest() if up_to is None else up_to
        view = TableView(store.rows(up_to), store.spec, ROW_ID)
        indexes = self._indexes(store, where, view, up_to)
        return search_view(view, where, select, snapshot=snapshot, indexes=indexes, **options)
