"""Greedy per-key state machines over ordered events. Rows stream through sorted partitions; memory is bounded by one key's window."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class SlidingLog:
    """Admits at most `limit` events within the trailing `seconds`; rejected ones are not logged."""

    def __init__(self, limit: int, seconds: float) -> None:
        self.limit, self.seconds, self.log = limit, seconds, deque()

    def __call__(self, at: float, _ok: bool) -> bool:
        while self.log and self.log[0] <= at - self.seconds:
            self.log.popleft()
        if len(self.log) >= self.limit:
            return False
        self.log.append(at)
        return True


class Debounce:
    """Admits an event if the last one, admitted or not, is `seconds` away."""

    def __init__(self, seconds: float) -> None:
        self.seconds, self.last = seconds, None

    def __call__(self, at: float, _ok: bool) -> bool:
        free = self.last is None or at - self.last >= self.seconds
        self.last = at
        return free


class Breaker:
    """Opens after `failures` consecutive failures and lets one call try again after `cooldown` seconds."""

    def __init__(self, failures: int, cooldown: float) -> None:
        self.failures, self.cooldown, self.count, self.opened = failures, cooldown, 0, None

    def __call__(self, at: float, ok: bool) -> bool:
        if self.opened is not None and at - self.opened < self.cooldown:
            return False
        if ok:
            self.count, self.opened = 0, None
        else:
            self.count += 1
            if self.count >= self.failures:
                self.opened = at
        return True


def admit(df: DataFrame, key: str, time: str, order: str, machine: Callable[[], Callable[[float, bool], bool]], ok: str | None = None) -> DataFrame:
    """df's key, time and order columns with `admitted`: each key's events in order of (time, order) through its own machine.

    Null keys are a key of their own; null times come first and count as time 0.
    """
    kinds = dict(df.dtypes)
    schema = f"{key} {kinds[key]}, {time} {kinds[time]}, {order} {kinds[order]}, admitted boolean"
    fine = F.col(ok) if ok else F.lit(True)
    rows = df.select(key, time, order, fine.alias("_ok"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("_t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, step = object(), None
        for b in batches:
            out = []
            for k, t, good in zip(b[key], b["_t"], b["_ok"]):
                if k != own and not (pd.isna(k) and own is None) or step is None:
                    own, step = None if pd.isna(k) else k, machine()
                out.append(bool(step(0.0 if pd.isna(t) else t, bool(good))))
            yield b[[key, time, order]].assign(admitted=out)

    return rows.repartition(F.col(key)).sortWithinPartitions(key, time, order).mapInPandas(run, schema)
