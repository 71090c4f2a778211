"""Which runs of batches have been rewritten together, and which to rewrite next.

A range is noted by a small file ``tier-after-upto``: it holds the batches after ``after`` up to ``upto``. Ranges of a tier
are merged into one of the next as soon as there are so many of them, so each row is rewritten once per tier and the
number of ranges grows with the logarithm of the batches. A range within another of a higher tier counts no more.
"""

from __future__ import annotations

from typing import NamedTuple

from tarnseek.sources.storage import Folder

FAN = 10


class Range(NamedTuple):
    tier: int
    after: int
    upto: int

    @property
    def name(self) -> str:
        return f"{self.tier}-{self.after + 1}-{self.upto}"


class Ranges:
    def __init__(self, notes: Folder):
        self._notes = notes

    def live(self) -> list[Range]:
        """The ranges to read, in order of their batches."""
        noted = []
        for name in self._notes.names():
            tier, first, upto = map(int, name.split("-"))
            noted.append(Range(tier, first - 1, upto))
        live = [r for r in noted if not any(o.tier > r.tier and o.after <= r.after and r.upto <= o.upto for o in noted)]
        return sorted(live, key=lambda r: r.upto)

    def covered(self) -> int:
        return max((r.upto for r in self.live()), default=-1)

    def note(self, new: Range) -> None:
        self._notes.put_new(new.name)

    def to_merge(self, fan: int = FAN) -> list[Range]:
        """The last ranges, if they are of one tier and enough."""
        live = self.live()
        same = []
        for r in reversed(live):
            if same and r.tier != same[-1].tier:
                break
            same.append(r)
        return same[::-1] if len(same) >= fan else []

    def forget(self) -> None:
        """Remove the notes of ranges that count no more."""
        live = {r.name for r in self.live()}
        for name in self._notes.names():
            if name not in live:
                self._notes.child(name).remove()
