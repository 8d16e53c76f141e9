"""Ordered patterns and bounded buffers on streams: state with timers on event time.

Events wait in state until the watermark has passed them and are then taken in order of time, so what arrives
in another order, or in another batch, is still matched. Keys of patterns share a state by groups, as the calls for each state are
what such a stream costs; a group's next timer is that of its next waiting event or of the next thing that expires.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams with state of their own keep it in RocksDB; the setting counts when a stream starts, and goes back after that."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _micros(values: pd.Series) -> list[int]:
    return values.astype("datetime64[us]").astype("int64").tolist()


def _times(micros: list[int | None]) -> pd.Series:
    return pd.to_datetime(pd.Series(micros, dtype="Int64"), unit="us")


#: Groups of keys that share a state: reading and writing one costs about as much as a key's own would.
GROUPS = 128


def _keyed(df: DataFrame, keys: list[str], ts: str, tie: str, kind: str, groups: int) -> DataFrame:
    """df with its keys as text (nulls stay null, and no number becomes a float on its way) and their group."""
    if any(isinstance(df.schema[k].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)) for k in keys):
        raise ValueError("keys must be plain values: take the parts of nested ones, and hex of binary ones")
    text = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
    return df.select(F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group"), *text, ts, tie, kind)


def _restored(out: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    return out.select(*(F.col(f"k{i}").cast(df.schema[k].dataType).alias(k) for i, k in enumerate(keys)), *out.columns[len(keys) :])


class _Waiting(StatefulProcessor):
    """What the processors share: a group's events (key, micros, tie, what) that wait for the watermark, and one timer a group."""

    def __init__(self, columns: tuple[str, str, str], tie: str, what: str, keys: int):
        self.columns, self.keys = columns, [f"k{i}" for i in range(keys)]
        self.key_types = ", ".join(f"{k} string" for k in self.keys)
        self.types = f"{self.key_types}, at long, tie {tie}, what {what}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.types)

    def arrived(self, parts: Iterator[pd.DataFrame], wanted: set) -> tuple[list[tuple], set[tuple]]:
        """The events of a batch of the wanted types, those without a time aside, and the keys of all its rows."""
        out: list[tuple] = []
        seen: set[tuple] = set()
        for part in parts:
            seen.update(self._named(part.drop_duplicates(self.keys)))
            part = part[part[self.columns[0]].notna() & part[self.columns[2]].isin(wanted)]
            at, tie, what = (part[c] for c in self.columns)
            out += zip(self._named(part), _micros(at), (None if pd.isna(t) else t for t in tie.tolist()), what.tolist(), strict=True)
        return out, seen

    def _named(self, part: pd.DataFrame) -> list[tuple]:
        return list(zip(*([None if pd.isna(v) else v for v in part[k].tolist()] for k in self.keys), strict=True))

    def held(self, state) -> list[tuple]:
        """Rows of a list state, each with its key as one."""
        n = len(self.keys)
        return [(tuple(row[:n]), *row[n:]) for row in state.get()]

    def keep(self, state, rows: list[tuple]) -> None:
        state.put([(*row[0], *row[1:]) for row in rows]) if rows else state.clear()

    def ready(self, new: list[tuple], watermark: int) -> tuple[list[tuple], list[tuple]]:
        """Waiting and new events in order: those that the watermark (ms) has passed, and the others, which go on waiting."""
        events = sorted([*self.held(self.waiting), *new], key=lambda e: (e[1], e[2] is not None, e[2]))
        n = sum(e[1] // 1000 <= watermark for e in events)
        if events:
            self.keep(self.waiting, events[n:])
        return events[:n], events[n:]

    def wake(self, *micros: int | None) -> None:
        """The group's one timer is at the first of these times."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if times := [m for m in micros if m is not None]:
            self.handle.registerTimer(min(times) // 1000 + 1)

    def table(self, names: list[tuple], **columns: object) -> pd.DataFrame:
        return pd.DataFrame({k: pd.Series([n[i] for n in names], dtype=object) for i, k in enumerate(self.keys)} | columns)

    def close(self) -> None:
        pass


class _Patterns(_Waiting):
    """Each event of the first type begins a run, which takes its key's next event of the next type, and so on."""

    def __init__(self, columns, tie, keys, wanted, within):
        super().__init__(columns, tie, "string", keys)
        self.wanted, self.within, self.tie = wanted, within, tie

    def init(self, handle):
        super().init(handle)
        self.runs = handle.getListState("runs", f"{self.key_types}, at long, tie {self.tie}, step int")

    def handleInputRows(self, key, rows, timerValues):
        yield from self._go_on(self.arrived(rows, set(self.wanted))[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._go_on([], timerValues.getCurrentWatermarkInMs())

    def _go_on(self, new, watermark):
        ready, left = self.ready(new, watermark)
        runs, out = {}, []  # of each key, in order of their beginnings
        for name, *run in self.held(self.runs):
            runs.setdefault(name, []).append(tuple(run))
        for name, at, tie, what in ready:
            still = []
            for began, first, step in self._expire(name, runs.get(name, []), at, out):
                step += self.wanted[step] == what
                if step == len(self.wanted):
                    out.append((name, began, first, at, step, True))
                else:
                    still.append((began, first, step))
            if what == self.wanted[0]:
                if len(self.wanted) == 1:
                    out.append((name, at, tie, at, 1, True))
                else:
                    still.append((at, tie, 1))
            runs[name] = still
        kept = [(name, *run) for name, own in runs.items() for run in self._expire(name, own, watermark * 1000, out)]
        self.keep(self.runs, kept)
        self.wake(left[0][1] if left else None, min(run[1] for run in kept) + self.within if kept else None)
        if out:
            names, began, first, ended, matched, complete = zip(*out, strict=True)
            yield self.table(list(names), started=_times(list(began)), tie=list(first), ended=_times(list(ended)), matched=list(matched), complete=list(complete))

    def _expire(self, name, runs, now, out):
        out += [(name, began, first, None, step, False) for began, first, step in runs if now - began > self.within]
        return [r for r in runs if now - r[0] <= self.within]


def patterns(df: DataFrame, keys: list[str], ts: str, tie: str, kind: str, wanted: list[str], within: int, late: str = "15 seconds", groups: int = GROUPS) -> DataFrame:
    """(keys, started, tie, ended, matched, complete): every run of events of the wanted types in order, with any others between.

    Every event of the first type begins a run, which takes the next event of the next type as its next, up to within
    seconds after its first. A run is given when it is complete, or (ended null) with the steps that it reached once its time has
    passed; nothing is given before the watermark has passed it. Events of one time come in order of tie, nulls first. Rows without a time or type count for nothing;
    what comes later than late is dropped. State of a key: its events of the wanted types not yet passed by the watermark, and its open runs.
    Keys share so many groups, whose state and new rows of a batch are one task's at a time; more groups make these smaller.
    """
    df = df.select(*keys, ts, tie, kind)
    of = lambda c: df.schema[c].dataType.simpleString()
    schema = ", ".join([*(f"k{i} string" for i in range(len(keys))), "started timestamp", f"tie {of(tie)}", "ended timestamp", "matched int", "complete boolean"])
    work = _Patterns((ts, tie, kind), of(tie), len(keys), wanted, within * 1_000_000)
    grouped = _keyed(df, keys, ts, tie, kind, groups).withWatermark(ts, late).groupBy("_group")
    return _restored(grouped.transformWithStateInPandas(work, schema, "append", "eventTime"), df, keys)


class _Progress(_Waiting):
    """How far each key's events have come through the wanted types: what the watermark has passed is kept as a step."""

    def __init__(self, columns, tie, keys, wanted):
        super().__init__(columns, tie, "string", keys)
        self.wanted = wanted

    def init(self, handle):
        super().init(handle)
        self.reached = handle.getListState("reached", f"{self.key_types}, step int")

    def _go_on(self, new, watermark):
        """How far each key has come by what the watermark has passed, which is kept, and the events that wait."""
        done, left = self.ready(new, watermark)
        before = dict(self.held(self.reached))
        reached = before.copy()
        self._step(reached, done)
        if reached != before:
            self.keep(self.reached, list(reached.items()))
        self.wake(left[0][1] if left else None)
        return reached, left

    def _step(self, reached, events):
        for name, _, _, what in events:
            step = reached.get(name, 0)
            if step < len(self.wanted) and what == self.wanted[step]:
                reached[name] = step + 1

    def handleInputRows(self, key, rows, timerValues):
        new, seen = self.arrived(rows, set(self.wanted))
        reached, left = self._go_on(new, timerValues.getCurrentWatermarkInMs())
        self._step(reached, left)
        names = list(seen)
        yield self.table(names, matched=[reached.get(n, 0) for n in names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._go_on([], timerValues.getCurrentWatermarkInMs())
        return iter(())


def progress(df: DataFrame, keys: list[str], ts: str, tie: str, kind: str, wanted: list[str], late: str = "15 seconds", groups: int = GROUPS) -> DataFrame:
    """(keys, matched, confidence) after each batch, for update mode: how many of the wanted types, in order with any
    others between, a key's events have matched so far, greedily from the first; the number never falls. Keys share groups as in patterns."""
    df = df.select(*keys, ts, tie, kind)
    of = lambda c: df.schema[c].dataType.simpleString()
    schema = ", ".join([*(f"k{i} string" for i in range(len(keys))), "matched int"])
    work = _Progress((ts, tie, kind), of(tie), len(keys), wanted)
    grouped = _keyed(df, keys, ts, tie, kind, groups).withWatermark(ts, late).groupBy("_group")
    out = _restored(grouped.transformWithStateInPandas(work, schema, "update", "eventTime"), df, keys)
    return out.withColumn("confidence", F.col("matched") / F.lit(float(len(wanted))))


class _Buffer(StatefulProcessor):
    """The newest values of a key: a bounded number, none older than an age before the newest."""

    def __init__(self, columns, tie, keys, most, age):
        self.columns, self.tie, self.keys, self.most, self.age = columns, tie, keys, most, age

    def init(self, handle):
        self.handle = handle
        self.held = handle.getListState("held", f"at long, tie {self.tie}, value double")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows, timerValues):
        new = []
        for part in rows:
            part = part[part[self.columns[0]].notna()]
            at, tie, value = (part[c] for c in self.columns)
            new += zip(_micros(at), (None if pd.isna(t) else t for t in tie.tolist()), (None if pd.isna(v) else float(v) for v in value.tolist()), strict=True)
        held = sorted([*map(tuple, self.held.get()), *new], key=lambda e: (e[0], e[1] is not None, e[1]))
        if not held:
            return
        seen = (self.seen.get()[0] if self.seen.exists() else 0) + len(new)
        newest = held[-1][0]
        held = [e for e in held[-self.most :] if e[0] > newest - self.age]
        self.held.put(held)
        self.seen.update((seen,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((newest + self.age) // 1000 + 1)
        yield self._row(key, held, newest, seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        newest = max((e[0] for e in self.held.get()), default=0)
        self.held.clear()
        self.seen.clear()
        yield self._row(key, [], newest + self.age, 0)

    def _row(self, key, held, as_of, seen):
        values = [v for _, _, v in held if v is not None]
        numbers = {"n": len(held), "total": sum(values) if values else None, "low": min(values, default=None), "high": max(values, default=None)}
        return pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key, strict=True)}, **{k: [v] for k, v in numbers.items()}, "oldest": _times([held[0][0] if held else None]), "as_of": [as_of], "seen": [seen]})

    def close(self):
        pass


def buffered(df: DataFrame, keys: list[str], ts: str, tie: str, value: str, most: int = 10_000, age: int = 86_400, late: str = "15 seconds") -> DataFrame:
    """(keys, n, total, low, high, oldest, revision) of each key's buffer after each batch that touches it, for update mode.

    A buffer holds a key's newest rows, most at most and none as old as age seconds before the newest; what goes beyond is dropped, the
    oldest first. Once the watermark is age past the newest, the key's state is gone and a row with n 0 is given. revision grows with every
    change of a key (its latest row wins). Rows without a time count for nothing, null values count in n alone.
    """
    df = df.select(*keys, ts, tie, value).withWatermark(ts, late)
    of = lambda c: df.schema[c].dataType.simpleString()
    schema = ", ".join([*(f"`{k}` {of(k)}" for k in keys), "n long, total double, low double, high double, oldest timestamp, as_of long, seen long"])
    work = _Buffer((ts, tie, value), of(tie), keys, most, age * 1_000_000)
    out = df.groupBy(*keys).transformWithStateInPandas(work, schema, "update", "eventTime")
    return out.withColumn("revision", F.struct("as_of", "seen")).drop("as_of", "seen")
