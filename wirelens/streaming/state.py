"""Keyed state: alert cooldown and packet flows over streams.

Both need the RocksDB state store (``ROCKSDB``) and an event-time watermark on ``ts``.
Rows wait in the state until the watermark has passed them and are then taken in time order, so
the answer does not depend on how rows fall into micro-batches.  What lies behind the watermark is late and dropped
by Spark before it reaches the state.

A state group is a bucket of many keys (``buckets`` of them, dealt by the hash of the key).  A Python call and a few
state requests serve a whole bucket, whatever the number of keys, and rows travel to the state as Arrow tables, not one by one.
A bucket holds the rows of one watermark delay and the open state of its keys; a stream that has begun must keep its number of buckets.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from wirelens import constants as K
from wirelens.functions.time import micros
from wirelens.operators.packets import KEY, packet_flow_key

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


BUCKETS = 1024
BLOB_ROWS = 100_000  # rows of one state value


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def _packed(rows: pd.DataFrame) -> list[tuple]:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    blobs = []
    for at in range(0, len(rows), BLOB_ROWS):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table.slice(at, BLOB_ROWS))
        blobs.append((out.getvalue().to_pybytes(),))
    return blobs


def _unpacked(state, columns: list[str]) -> pd.DataFrame:
    blobs = [pa.ipc.open_stream(bytes(blob)).read_pandas() for (blob,) in state.get()] if state.exists() else []
    return pd.concat(blobs, ignore_index=True) if blobs else pd.DataFrame(columns=columns)


def _replace(state, rows: pd.DataFrame) -> None:
    if len(rows):
        state.put(_packed(rows))
    else:
        state.clear()


class _InTimeOrder(StatefulProcessor):
    """Keeps the rows of a bucket until the watermark has passed them and hands them on in the order of key, ``us`` and row id."""

    keys: list[str]
    waiting: list[str]  # further columns of a waiting row, ``us`` first
    kept: list[str]  # columns of the state of a key, after the key

    def init(self, handle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "rows binary")
        self.open = handle.getListState("open", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True)[[*self.keys, *self.waiting]]
        self.queue.appendList(_packed(new))
        self.handle.registerTimer(int(new["us"].min()) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        done = timerValues.getCurrentWatermarkInMs() * 1000
        rows = _unpacked(self.queue, [*self.keys, *self.waiting])
        due = (rows["us"] <= done).to_numpy(dtype=bool)
        if due.any():
            left = rows[~due]
            _replace(self.queue, left)
            if len(left):
                self.handle.registerTimer(int(left["us"].min()) // 1000 + 1)
        held = _unpacked(self.open, [*self.keys, *self.kept])
        out, held, ends = self.advance(rows[due], held, done)
        _replace(self.open, held)
        if len(ends):
            self.handle.registerTimer(int(ends.min()) // 1000 + 1)
        if len(out):
            yield out

    def advance(self, due: pd.DataFrame, held: pd.DataFrame, done: int):
        """Rows to give out, the state to keep, and the times at which the kept state ends."""
        raise NotImplementedError

    def number(self, rows: pd.DataFrame) -> np.ndarray:
        return rows.groupby(self.keys, sort=False, dropna=False).ngroup().to_numpy()

    def close(self) -> None:
        pass


class _Cooldown(_InTimeOrder):
    """Keeps the last admitted time of a pair; the state goes when the cooldown is over."""

    waiting, kept = ["us", "row"], ["last"]

    def __init__(self, cooldown_us: int, pair: list[str]):
        self.cooldown_us, self.keys = cooldown_us, pair

    def advance(self, due, held, done):
        due = due.assign(last=-1)
        rows = pd.concat([held.assign(us=-1, row=None), due], ignore_index=True) if len(held) else due
        rows = rows.assign(_key=self.number(rows)).sort_values(["_key", "us", "row"]).reset_index(drop=True)
        times, known, code = (rows[c].to_numpy(dtype="int64") for c in ("us", "last", "_key"))
        passed, lasts = np.zeros(len(rows), dtype=bool), np.full(len(rows), -1, dtype="int64")
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            i, last = a, None
            if known[a] != -1:
                last = int(known[a])
                i = a + 1 + int(np.searchsorted(times[a + 1:b], last + self.cooldown_us))
            while i < b:
                last, passed[i] = int(times[i]), True
                i += int(np.searchsorted(times[i:b], last + self.cooldown_us)) or 1
            lasts[a] = last
        is_row = known == -1
        out = rows[is_row]
        out = pd.DataFrame({"row": out["row"].astype(due["row"].dtype) if len(out) else out["row"], **{c: out[c] for c in self.keys},
                            "us": times[is_row], "ts": pd.to_datetime(times[is_row], unit="us"), "admitted": passed[is_row]})
        left = rows.loc[starts, self.keys].assign(last=lasts[starts])
        left = left[left["last"] + self.cooldown_us > done]
        return out, left, left["last"] + self.cooldown_us


def stream_cooldown(alerts: DataFrame, cooldown_s: float = K.ALERT_COOLDOWN_S, row_id: str = "flow_id",
                    pair=("src_ip", "dst_ip"), delay: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """Alerts (row, pair, us) with ``admitted``: at most one per pair and cooldown.  An alert is given
    out once the watermark, ``delay`` behind the newest alert, has passed it."""
    pair = list(pair)
    rows = alerts.withWatermark("ts", delay).select(
        F.col(row_id).alias("row"), *pair, micros(F.col("ts")).alias("us"), "ts")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"row {types['row']}", *[f"{c} {types[c]}" for c in pair],
                        "us long", "ts timestamp", "admitted boolean"])
    timed = rows.where(F.col("us").isNotNull()).withColumn("bucket", _bucket(pair, buckets))
    return timed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Cooldown(int(cooldown_s * 1e6), pair), outputStructType=schema,
        outputMode="Append", timeMode="EventTime")


_FLOW = ["start_us", "end_us", "fwd_pkts", "fwd_bytes", "bwd_pkts", "bwd_bytes"]


class _Flows(_InTimeOrder):
    """The open flow of a key; a flow is given out when silence or age closes it."""

    keys, waiting, kept = KEY, ["us", "direction", "size"], _FLOW

    def __init__(self, idle_us: int, active_us: int):
        self.idle_us, self.active_us = idle_us, active_us

    def advance(self, due, held, done):
        fwd = (due["direction"] == 0).to_numpy().astype("int64")
        size = due["size"].fillna(0).to_numpy(dtype="int64")
        us = due["us"].to_numpy(dtype="int64")
        single = due[self.keys].assign(start_us=us, end_us=us, fwd_pkts=fwd, fwd_bytes=fwd * size, bwd_pkts=1 - fwd,
                                       bwd_bytes=(1 - fwd) * size, _new=1)
        rows = pd.concat([held.assign(_new=0), single], ignore_index=True) if len(held) else single
        if not len(rows):
            return rows, rows, rows
        # an open flow comes first in its key, then the packets; each takes part as a flow of its own
        rows = rows.assign(_key=self.number(rows)).sort_values(["_key", "_new", "start_us"]).reset_index(drop=True)
        code, start = rows["_key"].to_numpy(), rows["start_us"].to_numpy(dtype="int64")
        latest = rows.groupby("_key")["end_us"].cummax().to_numpy(dtype="int64")
        first = np.ones(len(rows), dtype=bool)
        first[1:] = (code[1:] != code[:-1]) | (start[1:] - latest[:-1] > self.idle_us)
        begins = np.flatnonzero(first)
        ends = np.append(begins[1:], len(rows))
        aged = start[ends - 1] - start[begins] > self.active_us
        for a, b in zip(begins[aged].tolist(), ends[aged].tolist()):
            while (a := a + int(np.searchsorted(start[a:b], start[a] + self.active_us, side="right"))) < b:
                first[a] = True
        begins = np.flatnonzero(first)
        flows = rows.loc[begins, self.keys].assign(
            start_us=start[begins], end_us=np.maximum.reduceat(rows["end_us"].to_numpy(dtype="int64"), begins),
            **{c: np.add.reduceat(rows[c].to_numpy(dtype="int64"), begins) for c in _FLOW[2:]})
        last = np.append(np.diff(code[begins]) != 0, True)
        stays = last & (flows["end_us"].to_numpy() + self.idle_us > done)
        left = flows[stays]
        return flows[~stays].astype({"port_a": "int32", "port_b": "int32", "proto": "int32"}), left, left["end_us"] + self.idle_us


def stream_flow_sessions(packets: DataFrame, idle_s: float = K.IDLE_TIMEOUT_S,
                         active_s: float = K.ACTIVE_TIMEOUT_S, delay: str = "5 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Flows with direction totals, given out when the watermark passes their idle limit or the first
    packet past their active limit."""
    keyed = packet_flow_key(packets.withWatermark("ts", delay), keep=["ts"]).where(F.col("us").isNotNull()).select(
        _bucket(KEY, buckets), *KEY, "ts", "us", "direction", "size")
    schema = ("ip_a string, ip_b string, port_a int, port_b int, proto int, "
              + ", ".join(f"{c} long" for c in _FLOW))
    return keyed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Flows(int(idle_s * 1e6), int(active_s * 1e6)), outputStructType=schema,
        outputMode="Append", timeMode="EventTime")


def stream_idle_sessions(packets: DataFrame, idle_s: float = K.IDLE_TIMEOUT_S, delay: str = "5 seconds") -> DataFrame:
    """Idle-only sessions with built-in session windows (partial aggregation, no Python)."""
    keyed = packet_flow_key(packets.withWatermark("ts", delay), keep=["ts"])
    gap = F.session_window("ts", f"{idle_s} seconds")
    return keyed.groupBy(*KEY, gap).agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("packets")).drop("session_window")
