"""State processors of the streaming operators.

``handleInputRows`` gets a key's rows of a micro-batch in pieces.  A piece is
reduced as it comes: the bounded log keeps its newest n entries, the others
keep plain arrays of numbers.  State is list or value state with one entry
for each log line or open tab; timers are in event time.  (Column names do not
begin with an underscore, as rows come by way of named tuples.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class BoundedLog(StatefulProcessor):
    """ST1: the newest n entries after the last reset or close."""

    def __init__(self, key: str, n: int, reset_type: str, close_type: str | None, idle_s: float | None):
        self.key, self.n, self.idle_us = key, n, None if idle_s is None else int(idle_s * 1e6)
        self.ends = [x for x in (reset_type, close_type) if x is not None]
        self.close_type = close_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "us long, id long, type string")

    def _rows(self, key, change: str, entries) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(entries), "change": [change] * len(entries),
                             "id": [e[1] for e in entries], "type": [e[2] for e in entries]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = [tuple(e) for e in self.log.get()] if self.log.exists() else []
        mark, new = None, []            # the last end so far; the newest n entries after it
        newest = max((e[0] for e in old), default=None)
        for piece in rows:
            found = sorted(zip(piece["w_us"].tolist(), piece["w_id"].tolist(), piece["w_type"].tolist()), key=lambda e: e[:2])
            newest = found[-1][0] if newest is None else max(newest, found[-1][0])
            ends = [e for e in found if e[2] in self.ends]
            if ends:
                mark = ends[-1] if mark is None else max(mark, ends[-1], key=lambda e: e[:2])
            new = [e for e in [*new, *found] if e[2] not in self.ends and (mark is None or e[:2] > mark[:2])]
            new = sorted(new, key=lambda e: e[:2])[-self.n:]
        now = ([*old, *new] if mark is None else new)[-self.n:]
        gone = old[:len(old) - (len(now) - len(new))] if mark is None else old
        if now:
            self.log.put(now)
        else:
            self.log.clear()
        if self.idle_us is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if now:
                self.handle.registerTimer((newest + self.idle_us) // 1000)
        if gone:
            yield self._rows(key, "drop", gone)
        come = now[len(now) - min(len(new), len(now)):]
        if come:
            yield self._rows(key, "add", come)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = [tuple(e) for e in self.log.get()] if self.log.exists() else []
        self.log.clear()
        if old:
            yield self._rows(key, "drop", old)


class LiveTabs(StatefulProcessor):
    """ST4: at most ``max_tabs`` open tabs; the oldest created one goes first."""

    def __init__(self, key: str, max_tabs: int):
        self.key, self.max_tabs = key, max_tabs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [(p["w_us"].to_numpy(np.int64), p["w_id"].fillna(-1).to_numpy(np.int64), p["w_close"].to_numpy(bool),
                  p["w_target"].fillna(-1).to_numpy(np.int64)) for p in rows]
        us, ids, close, target = (np.concatenate(z) for z in zip(*parts))
        live = [e[0] for e in self.open.get()] if self.open.exists() else []
        opened, evictor = [], []
        for k in np.lexsort((ids, us)).tolist():
            if close[k]:
                if int(target[k]) in live:
                    live.remove(int(target[k]))
                continue
            live.append(int(ids[k]))
            if len(live) > self.max_tabs:
                opened.append(live.pop(0))
                evictor.append(int(ids[k]))
        if live:
            self.open.put([(i,) for i in live])
        else:
            self.open.clear()
        if opened:
            yield pd.DataFrame({self.key: [key[0]] * len(opened), "opened_event": opened, "evicted_by": evictor})


class QuietPoint(StatefulProcessor):
    """ST5: the first time that no event follows within ``idle``, at most ``timeout`` after the first event."""

    def __init__(self, key: str, idle_us: int, timeout_us: int):
        self.key, self.idle, self.timeout = key, idle_us, timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, last long")
        self.done = handle.getValueState("done", "done boolean")

    def _decide(self, key, first: int, quiet: int) -> pd.DataFrame:
        self.seen.clear()
        self.done.update((True,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        limit = first + self.timeout
        return pd.DataFrame({self.key: [key[0]], "idle_at_us": [min(quiet, limit)], "timed_out": [quiet > limit]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for _ in rows:
                pass
            return
        times = np.sort(np.concatenate([p["w_us"].to_numpy(np.int64) for p in rows]))
        if self.seen.exists():
            first, last = self.seen.get()
            times = np.concatenate([[last], times])
        else:
            first = int(times[0])
        quiet = times[:-1] + self.idle
        over = np.flatnonzero((times[1:] - times[:-1] >= self.idle) | (quiet > first + self.timeout))
        if len(over):
            yield self._decide(key, first, int(quiet[over[0]]))
            return
        last = int(times[-1])
        if last + self.idle > first + self.timeout:
            yield self._decide(key, first, last + self.idle)
            return
        self.seen.update((first, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer((last + self.idle) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            first, last = self.seen.get()
            yield self._decide(key, first, last + self.idle)
