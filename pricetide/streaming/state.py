"""Stateful processors of the streams. They need the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor


class NewestFetch(StatefulProcessor):
    """The newest fetch of one key, until its time to live has passed in event time.

    A row that is newer than the stored one replaces it and is handed on as live; when the watermark reaches the end of its
    life it is handed on once more, no longer live, and forgotten.
    """

    NEWEST = "us long, seq long, digest string, expires long, row string"
    OUT = "fetch_key string, us long, expires long, row string, live boolean"

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.NEWEST)

    def _out(self, key, state, live: bool) -> pd.DataFrame:
        return pd.DataFrame({"fetch_key": [key[0]], "us": [state[0]], "expires": [state[3]], "row": [state[4]], "live": [live]})

    def handleInputRows(self, key, rows, timerValues):
        old = tuple(self.newest.get()) if self.newest.exists() else None
        best = old
        for part in rows:
            for row in part[["us", "seq", "digest", "expires", "row"]].itertuples(index=False, name=None):
                row = (int(row[0]), int(row[1]), row[2], int(row[3]), row[4])
                if best is None or row[:3] > best[:3]:
                    best = row
        if best != old:
            if old is not None:
                self.handle.deleteTimer(old[3] * 1000)
            self.newest.update(best)
            self.handle.registerTimer(best[3] * 1000)
            yield self._out(key, best, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.newest.exists():
            gone = tuple(self.newest.get())
            self.newest.clear()
            yield self._out(key, gone, False)

    def close(self) -> None:
        pass


class Circuits(StatefulProcessor):
    """The circuits of all providers from what each task has made of its rows (see ``jobs.stream_circuits``).

    A provider's state is its last success, how many counted failures came after it, and the moments of those failures that
    are recent: a success that arrives late clears the failures before it and no others. What is older than ``lateness``
    before the newest row seen is settled: only its number is kept, and rows older than that no longer count. Spend is kept
    for each day until two days past its end.
    """

    PROVIDER = "ok_us long, ok_seq long, settled long, recent array<struct<us:long,seq:long>>, suspended boolean"
    OUT = "provider string, failures long, disabled_reason string, is_open boolean"
    DAY_US = 86_400_000_000

    def __init__(self, max_failures: int, budget_micros: int, paid: tuple[str, ...], lateness_us: int):
        self.max_failures, self.budget, self.paid, self.lateness = max_failures, budget_micros, paid, lateness_us

    def init(self, handle) -> None:
        self.providers = handle.getMapState("providers", "provider string", self.PROVIDER)
        self.days = handle.getMapState("days", "day long", "micros long")
        self.clock = handle.getValueState("clock", "us long")

    def handleInputRows(self, key, rows, timerValues):
        clock = self.clock.get()[0] if self.clock.exists() else None
        horizon = None if clock is None else clock - self.lateness
        held = {k[0]: [v[0], v[1], v[2], [tuple(x) for x in v[3]], v[4]] for k, v in self.providers.iterator()} if self.providers.exists() else {}
        spent = {k[0]: v[0] for k, v in self.days.iterator()} if self.days.exists() else {}
        on_time = lambda us: horizon is None or us >= horizon
        for part in rows:
            for r in part.to_dict("records"):
                clock = r["newest"] if clock is None else max(clock, r["newest"])
                for day, micros in zip(r["days"], r["micros"], strict=True):
                    if on_time((day + 3) * self.DAY_US):
                        spent[day] = spent.get(day, 0) + int(micros)
                one = held.setdefault(r["provider"], [None, None, 0, [], False])
                one[4] = one[4] or bool(r["suspended"])
                ok = None if pd.isna(r["ok_us"]) else (int(r["ok_us"]), int(r["ok_seq"]))
                if ok is not None and on_time(ok[0]) and (one[0] is None or ok > (one[0], one[1])):
                    one[0], one[1], one[2] = *ok, 0  # settled failures are older than any success that is on time
                one[3] += [(int(u), int(s)) for u, s in zip(r["failed_us"], r["failed_seq"], strict=True) if on_time(u)]
        for one in held.values():
            recent = [x for x in one[3] if one[0] is None or x > (one[0], one[1])]
            old = [x for x in recent if clock is not None and x[0] < clock - self.lateness]
            one[2], one[3] = one[2] + len(old), [x for x in recent if not old or x[0] >= clock - self.lateness]
        spent = {d: m for d, m in spent.items() if d == max(spent) or (d + 3) * self.DAY_US >= clock - self.lateness}
        for d, m in spent.items():
            self.days.updateValue((d,), (m,))
        for (d,) in [k for k in self.days.keys()] if self.days.exists() else []:
            if d not in spent:
                self.days.removeKey((d,))
        if clock is not None:
            self.clock.update((int(clock),))
        over = self.budget > 0 and bool(spent) and spent[max(spent)] > self.budget
        out = []
        for name, one in sorted(held.items()):
            self.providers.updateValue((name,), (one[0], one[1], one[2], one[3], one[4]))
            reason = "daily_budget_exceeded" if over and name in self.paid else "suspended_or_billing" if one[4] else None
            failures = one[2] + len(one[3])
            out.append((name, failures, reason, reason is not None or failures >= self.max_failures))
        yield pd.DataFrame(out, columns=["provider", "failures", "disabled_reason", "is_open"]).astype({"failures": "int64", "is_open": bool})

    def close(self) -> None:
        pass
