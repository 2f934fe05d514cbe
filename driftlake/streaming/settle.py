"""Settled diagnostics: a uri's set counts once it has not changed for a while, however often it is published again."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Microseconds of quiet.
QUIET = 1_500_000
SETTLED = "uri string, since timestamp, settled timestamp, n long, diagnostics array<string>"
_OUT = "uri string, since long, settled long, n long, diagnostics array<string>"


class _Settle(StatefulProcessor):
    """Publications wait in state until the watermark has passed them, so they are taken in order of time.

    ``open``: when the set last changed, how often it was published since, the
    set, and whether it was told. A timer stands at the first waiting
    publication and at the end of the quiet time.
    """

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long", "sets array<array<string>>")
        self.open = handle.getValueState("open", "since long, n long, told boolean, diagnostics array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for ts, found in zip(pdf["at"], pdf["diagnostics"], strict=True):
                at = (int(ts),)
                have = [list(x) for x in self.waiting.getValue(at)[0]] if self.waiting.containsKey(at) else []
                self.waiting.updateValue(at, ([*have, sorted(found) if found is not None else []],))
        return iter(self._taken(key, timerValues))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        return iter(self._taken(key, timerValues))

    def _taken(self, key: Any, timerValues: Any) -> list[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000  # nothing before it comes any more
        state = list(self.open.get()) if self.open.exists() else None
        out: list[tuple] = []

        def tell(until: int) -> None:
            if state and not state[2] and state[0] + self.quiet < until:
                out.append((key[0], state[0], state[0] + self.quiet, state[1], list(state[3])))
                state[2] = True

        left = sorted(k[0] for k in self.waiting.keys())
        while left and left[0] < now:
            ts = left.pop(0)
            for found in sorted(map(list, self.waiting.getValue((ts,))[0])):  # of one time: in order of the sets
                tell(ts)
                if state is None or found != list(state[3]):
                    state = [ts, 1, False, found]
                else:
                    state[1] += 1 if not state[2] else 0
            self.waiting.removeKey((ts,))
        tell(now)
        if state:
            self.open.update(tuple(state))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if left:
            self.handle.registerTimer(left[0] // 1000 + 1)
        if state and not state[2]:
            self.handle.registerTimer((state[0] + self.quiet) // 1000 + 1)
        return [pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])] if out else []

    def close(self) -> None:
        pass


def settled(events: DataFrame, quiet: int = QUIET, late: str = "10 seconds") -> DataFrame:
    """Of a stream of publications (uri, ts, diagnostics: array of strings) the sets that stayed unchanged for over ``quiet`` microseconds.

    uri, since (when the set was first published), settled, n (publications of
    it until then) and the set, sorted. A publication of an equal set does not
    start the clock again; one that comes after the watermark (``late``) is
    dropped; null sets are empty sets, and rows without uri are left out.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = events.where("uri is not null and ts is not null").withWatermark("ts", late)
    e = e.select("uri", "ts", F.unix_micros("ts").alias("at"), F.col("diagnostics").cast("array<string>").alias("diagnostics"))
    out = e.groupBy("uri").transformWithStateInPandas(_Settle(quiet), _OUT, "Append", "EventTime")
    return out.select("uri", *[F.timestamp_micros(c).alias(c) for c in ("since", "settled")], "n", "diagnostics")
