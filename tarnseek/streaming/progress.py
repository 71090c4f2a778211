"""What running streams have taken so far, from their own progress events.

Spark tells when a trigger has found nothing new, and since when that trigger ran: all that had arrived by then is
committed. For lists, which are read the oldest file first, a batch without a file of before some
moment says the same of that moment, so waiting ends too while a source keeps growing. Nothing is listed or read.
"""

from __future__ import annotations

import threading
import time
from datetime import datetime
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Milliseconds between two notes of Spark that a stream has nothing to do; its default is ten seconds.
IDLE_NOTES = "spark.sql.streaming.noDataProgressEventInterval"
IDLE_NOTE_MS = "100"


def _seconds(timestamp: str) -> float:
    return datetime.fromisoformat(timestamp.replace("Z", "+00:00")).timestamp()


class Progress(StreamingQueryListener):
    """For each run of a query: when the last trigger that found nothing began, and the last batch that took all there was."""

    def __init__(self):
        self._changed = threading.Condition()
        self._empty_since: dict[str, float] = {}
        self._oldest_file: dict[str, float] = {}
        self._takes_all: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        self._note(self._empty_since, str(event.runId), _seconds(event.timestamp))

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        if run in self._takes_all:
            self._note(self._empty_since, run, _seconds(event.progress.timestamp))
        else:
            self._note(self._empty_since, run, 0.0)

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._changed.notify_all()

    def takes_all(self, query: StreamingQuery) -> None:
        """Each batch of the query takes all that is there when its trigger begins."""
        self._takes_all.add(str(query.runId))

    def committed(self, run: str, oldest_file: float | None) -> None:
        """A batch is committed; the time of its oldest file, if it's known."""
        if oldest_file is not None:
            self._note(self._oldest_file, run, oldest_file)

    def _note(self, where: dict[str, float], run: str, at: float) -> None:
        with self._changed:
            where[run] = max(at, where.get(run, at))
            self._changed.notify_all()

    def wait(self, query: StreamingQuery, now: float, file_time: float, seconds: float) -> bool:
        """Wait until all that had arrived by ``now`` (``file_time`` by the clock of the files) is committed; False if it took longer."""
        run = str(query.runId)

        def done() -> bool:
            return self._empty_since.get(run, 0) >= now or self._oldest_file.get(run, 0) > file_time or not query.isActive

        until = time.monotonic() + seconds
        with self._changed:
            while not done():
                left = until - time.monotonic()
                if left <= 0:
                    return False
                # A stream may end without a note.
                self._changed.wait(min(left, 1.0))
        return True


_LISTENERS: WeakKeyDictionary[SparkSession, Progress] = WeakKeyDictionary()


def progress_of(spark: SparkSession) -> Progress:
    """The session's listener, added when it is first asked for."""
    if spark not in _LISTENERS:
        _LISTENERS[spark] = Progress()
        spark.streams.addListener(_LISTENERS[spark])
    return _LISTENERS[spark]
