"""Alert rules that need state between windows: sources that fall silent, conditions that hold for a while.

Both stand behind a windowed count, so a stateful operator feeds another: windows are given out once the
watermark has passed them, in order, and the state of a key is a few numbers.  They need the RocksDB state
store (``state.ROCKSDB``) and an event-time column ``ts``.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from wirelens import constants as K


class _Silence(StatefulProcessor):
    """The last slot of a key that is known; timers give out slots for keys that receive nothing."""

    def __init__(self, width_us: int, keys: list[str]):
        self.width, self.keys = width_us, keys

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def _out(self, key, slots: list[tuple[int, str]]):
        if slots:
            told = pd.DataFrame(slots, columns=["window_us", "state"])
            for i, (name, value) in enumerate(zip(self.keys, key)):
                told.insert(i, name, [value] * len(told))
            yield told

    def _wake(self) -> None:
        self.handle.registerTimer((self.last.get()[0] + 2 * self.width) // 1000)

    def handleInputRows(self, key, rows, timerValues):
        seen = pd.concat(list(rows)).sort_values("window_us")
        last = self.last.get()[0] if self.last.exists() else None
        slots = []
        for us, events in zip(seen["window_us"].tolist(), seen["events"].tolist()):
            if last is not None:
                slots += [(gap, "down") for gap in range(last + self.width, us, self.width)]
            if not events:
                slots.append((us, "silent"))
            last = us
        self.last.update((last,))
        self._wake()
        yield from self._out(key, slots)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        done = timerValues.getCurrentWatermarkInMs() * 1000
        last = self.last.get()[0]
        slots = [(us, "down") for us in range(last + self.width, done - self.width + 1, self.width)]
        if slots:
            self.last.update((slots[-1][0],))
            self._wake()
        yield from self._out(key, slots)

    def close(self) -> None:
        pass


def stream_silence(signs: DataFrame, event: Column, keys: list[str], slot_s: int = 300, delay: str = "1 minute") -> DataFrame:
    """(keys, window_us, state) for slots in which a key was ``down`` (no row at all) or ``silent`` (rows, but none that
    is an ``event``), from the key's first row on.  A slot is told once the watermark has passed it, also
    while the key receives nothing, as long as other keys move the watermark on.
    """
    slots = (signs.withColumn("_event", event).withWatermark("ts", delay).groupBy(*keys, F.window("ts", f"{slot_s} seconds").alias("w"))
             .agg(F.count_if("_event").alias("events")))
    types = {f.name: f.dataType.simpleString() for f in signs.schema.fields}
    placed = slots.select(*keys, F.unix_micros("w.start").alias("window_us"), "events", F.window_time("w").alias("ts"))
    return placed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Silence(slot_s * 1_000_000, keys), outputMode="Append", timeMode="EventTime",
        outputStructType=", ".join([*[f"{k} {types[k]}" for k in keys], "window_us long", "state string"]))


class _Sustained(StatefulProcessor):
    """The stretch of firing windows that a rule is in: pending until it has lasted, then firing, told once more when it ends."""

    def __init__(self, step_us: int, for_us: int):
        self.step, self.hold = step_us, for_us

    def init(self, handle) -> None:
        self.stretch = handle.getValueState("stretch", "begin long, last long, windows long, told boolean")

    def handleInputRows(self, key, rows, timerValues):
        seen = pd.concat(list(rows)).sort_values("window_us")
        held = list(self.stretch.get()) if self.stretch.exists() else None
        out = []

        def end():
            if held and held[1] - held[0] >= self.hold:
                out.append((key[0], *held[:3], "resolved"))
        for us, firing in zip(seen["window_us"].tolist(), seen["firing"].tolist()):
            if held and (not firing or us - held[1] != self.step):
                end()
                held = None
            if firing:
                held = [held[0], us, held[2] + 1, held[3]] if held else [us, us, 1, False]
                if us - held[0] >= self.hold and not held[3]:
                    held[3] = True
                    out.append((key[0], *held[:3], "firing"))
        if held:
            self.stretch.update(tuple(held))
        elif self.stretch.exists():
            self.stretch.clear()
        if out:
            yield pd.DataFrame(out, columns=["rule", "from_us", "to_us", "windows", "state"])

    def close(self) -> None:
        pass


def stream_sustained(rows: DataFrame, bad: Column, rule: str, size_s: int = 300, step_s: int = 60, limit: float = 0.1,
                     for_s: int = 600, delay: str = "1 minute") -> DataFrame:
    """(rule, from_us, to_us, windows, state): when the share of ``bad`` rows over sliding windows has exceeded ``limit`` for
    ``for_s`` (``firing``) and when that stretch has ended (``resolved``).  A window without rows ends a stretch.

    The counting is spread over all rows; the state sees one row per window.
    """
    counts = (rows.withColumn("_bad", bad).withWatermark("ts", delay)
              .groupBy(F.window("ts", f"{size_s} seconds", f"{step_s} seconds").alias("w"))
              .agg(F.count("*").alias("n"), F.count_if("_bad").alias("bad")))
    windows = counts.select(F.lit(rule).alias("rule"), F.unix_micros("w.start").alias("window_us"),
                            (F.col("bad") / F.col("n") > limit).alias("firing"), F.window_time("w").alias("ts"))
    return windows.groupBy("rule").transformWithStateInPandas(
        statefulProcessor=_Sustained(step_s * 1_000_000, for_s * 1_000_000), outputMode="Append", timeMode="EventTime",
        outputStructType="rule string, from_us long, to_us long, windows long, state string")


def attack_rate_rule(predictions: DataFrame, **options) -> DataFrame:
    return stream_sustained(predictions, F.col("prediction") != K.BENIGN, "attack_rate", **options)


def error_rate_rule(requests: DataFrame, **options) -> DataFrame:
    return stream_sustained(requests, F.col("status") >= 500, "error_rate", **{"limit": 0.01, "for_s": 300, **options})
