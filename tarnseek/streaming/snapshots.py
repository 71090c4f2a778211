"""Snapshots of a table that is still being written.

Each micro-batch that is wholly written is noted as committed. A snapshot token
is the number of the last committed batch: batches never change, so reading up
to it gives the same rows and total however many batches follow.
"""

from __future__ import annotations

import time

from tarnseek.errors import TarnseekError
from tarnseek.sources.storage import Folder

NO_TOKEN = -1
KEPT_COMMITS = 100


class SnapshotLog:
    def __init__(self, table: Folder, lifetime: float = 0):
        """``lifetime`` in seconds; 0 turns tokens off."""
        self._commits = table.child("commits")
        self._tokens = table.child("tokens")
        self.lifetime = lifetime

    def commit(self, batch: int) -> None:
        """Note a batch as wholly written. Only recent notes are kept."""
        self._commits.put_new(str(batch))
        if batch >= KEPT_COMMITS:
            self._commits.child(str(batch - KEPT_COMMITS)).remove()

    def is_committed(self, batch: int) -> bool:
        return batch <= self.latest()

    def latest(self) -> int:
        """The last committed batch, -1 before the first."""
        return max((int(n) for n in self._commits.names()), default=NO_TOKEN)

    def record(self) -> tuple[int, int]:
        """(batch to read up to, token to hand out); the token's age starts now."""
        batch = self.latest()
        if self.lifetime <= 0:
            return batch, NO_TOKEN
        self._prune()
        if batch >= 0:
            self._tokens.put_new(str(batch))
        return batch, batch

    def acquire(self, token: int) -> int:
        """The batch a token stands for, or an error if it isn't valid any more."""
        if self.lifetime <= 0:
            raise TarnseekError(f"snapshots are off, so token[{token}] can't be used")
        self._prune()
        if not self._tokens.exists(str(token)):
            raise TarnseekError(f"token[{token}] has expired, search again without it")
        return token

    def _prune(self) -> None:
        """Forget tokens handed out too long ago."""
        oldest = time.time() - (self.lifetime + 1)
        for token, handed_out in self._tokens.entries():
            if handed_out < oldest:
                self._tokens.child(token).remove()
