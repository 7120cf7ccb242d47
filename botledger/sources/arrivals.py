"""A ledger of the files that came into a folder, so that a stream reads each once, in whatever order and with whatever times they come.

A listing of the folder is compared with the set of files seen; what is new goes, at most so many
files at once, into the next numbered entry. An entry is written whole before its number is an
offset, and never changes: a batch that runs again after a failure reads the files it read before.
Entries hold path, size and time of each file. A path whose file has been replaced by one of
another size or time is a new file; a file must come in whole (moved, not grown).

Every FOLD entries the set seen is written in one piece, so that a start reads that and the few
entries after it. Files gone from the folder for longer than FORGET_DAYS leave the set: it stays
as large as the folder. Entries that the query is done with, but for the last KEEP, are deleted,
so a ledger belongs to one query.
"""

from __future__ import annotations

import json
import time

from botledger.sources import stores
from botledger.sources.stores import Found

FOLD, KEEP, FORGET_DAYS = 32, 100, 7
_DAY = 86_400


class Ledger:
    def __init__(self, folder: str, specs: list[str], most: int, clock=time.time):
        self.folder, self.specs, self.most, self.clock = stores.bare(folder).rstrip("/"), specs, most, clock
        self.seen: dict[Found, float] = {}  # with when the file was last there
        self.last = self.folded = 0
        self._load()

    def _path(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}-{number:012d}.json"

    def _numbers(self, kind: str) -> list[int]:
        names = stores.names(self.folder)
        return sorted(int(n[len(kind) + 1 : -5]) for n in names if n.startswith(kind + "-") and n.endswith(".json"))

    def _read(self, kind: str, number: int) -> list:
        with stores.open_file(self._path(kind, number)) as f:
            return json.loads(f.read())

    def _load(self) -> None:
        entries, folds = self._numbers("entry"), self._numbers("seen")
        self.folded = folded = folds[-1] if folds else 0
        if folds:
            self.seen = {Found(*x[:3]): x[3] for x in self._read("seen", folded)}
        for k in entries:
            if k > folded:
                self.seen |= {f: self.clock() for f in self.entry(k)}
        self.last = max([folded, *entries])

    def entry(self, number: int) -> list[Found]:
        return [Found(*x) for x in self._read("entry", number)]

    def look(self) -> int:
        """The number of the last entry, after one more has been written if there are new files; the oldest come first."""
        now, new = self.clock(), []
        for f in {f for s in self.specs for f in stores.listing(s, missing=True)}:
            if f in self.seen:
                self.seen[f] = now
            else:
                new.append(f)
        if new:
            new.sort(key=lambda f: (f.time, f.path))
            new = new[: self.most] if self.most else new
            stores.put(self._path("entry", self.last + 1), json.dumps(new).encode())
            self.last += 1
            self.seen |= {f: now for f in new}
        return self.last

    def between(self, start: int, end: int) -> list[Found]:
        return [f for k in range(start + 1, end + 1) for f in self.entry(k)]

    def done(self, number: int) -> None:
        """The query won't ask again for entries up to this one."""
        if number // FOLD <= self.folded // FOLD or number > self.last:
            return
        horizon = self.clock() - FORGET_DAYS * _DAY
        self.seen = {f: t for f, t in self.seen.items() if t >= horizon}
        later = {f for k in range(number + 1, self.last + 1) for f in self.entry(k)}
        stores.put(self._path("seen", number), json.dumps([[*f, t] for f, t in self.seen.items() if f not in later]).encode())
        self.folded = number
        for k in self._numbers("entry"):
            if k <= number - KEEP:
                stores.delete(self._path("entry", k))
        for k in self._numbers("seen"):
            if k < number:
                stores.delete(self._path("seen", k))
