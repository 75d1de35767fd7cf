"""Adaptive periods on a stream, with state in Spark's own store and an end for every session.

Each (session, node, sensor) keeps its latest clock and period, the totals so
far and its latest losses.  When event time has moved on past its last packet,
a timer writes what became of it as one row and clears the state, so the store
holds what is running and not all that ever ran.

A key's packets of one micro-batch pass one task in order; streams whose keys are
too hot for that run :func:`gustline.streaming.batches.period_drift_stream`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gustline.operators.gaps import PACKET_KEYS

#: Losses that a finished session's row lists.
LATEST_LOSSES = 5
#: Packets of the stream have a ``seq``; the row that ends a session has totals instead.
OUTPUT_SCHEMA = (
    "session_id string, packet_origin string, sensor_name string, seq bigint, is_first boolean, measured_period double, "
    "current_period double, lost boolean, gap_ms double, finished boolean, packets bigint, lost_packets bigint, "
    "total_gap_ms double, latest_losses array<bigint>"
)


class DriftProcessor(StatefulProcessor):
    """One key's packets in order of ``seq``; needs node_ticks, samples_in_packet, period and event_ms."""

    def __init__(self, max_drift: float, idle_ms: int):
        self.max_drift, self.idle_ms = max_drift, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.running = handle.getValueState(
            "running", "ticks bigint, period double, packets bigint, lost bigint, gap_ms double, ends_ms bigint"
        )
        self.losses = handle.getListState("losses", "seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # tasks have the package; the process that sets the state up has only this class
        from gustline.catalogue import NODE_CLOCK_HZ
        from gustline.operators.gaps import run_rule

        packets = pd.concat(list(rows)).sort_values("seq", ignore_index=True)
        known = self.running.get() if self.running.exists() else None
        ticks = packets["node_ticks"].to_numpy(np.int64)
        before = np.concatenate([[known[0] if known else 0], ticks[:-1]])
        spacing = (ticks - before).astype(float)
        if not known:
            spacing[0] = np.nan
        measured = spacing / packets["samples_in_packet"].to_numpy() / NODE_CLOCK_HZ
        held = known[1] if known else float(packets["period"].iloc[0])
        values, replaced = run_rule(measured, np.full(len(packets), self.max_drift), "close", held)
        first = np.isnan(spacing)
        lost = ~replaced & ~first
        gaps = np.where(lost, spacing / NODE_CLOCK_HZ * 1000, np.nan)
        totals = known[2:5] if known else (0, 0, 0.0)
        ends = max(int(packets["event_ms"].max()) + self.idle_ms, known[5] if known else 0)
        self.running.update(
            (
                int(ticks[-1]),
                float(values[-1]),
                totals[0] + len(packets),
                totals[1] + int(lost.sum()),
                totals[2] + float(np.nansum(gaps)),
                ends,
            )
        )
        if lost.any():
            seqs = [r[0] for r in self.losses.get()] + packets["seq"][lost].tolist()
            self.losses.put([(int(s),) for s in seqs[-LATEST_LOSSES:]])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ends)
        yield _rows(
            key,
            len(packets),
            seq=packets["seq"],
            is_first=first,
            measured_period=measured,
            current_period=values,
            lost=lost,
            gap_ms=gaps,
            finished=False,
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.running.exists():
            _, period, packets, lost, gap_ms, _ = self.running.get()
            losses = [[r[0] for r in self.losses.get()]]
            self.running.clear()
            self.losses.clear()
            yield _rows(
                key,
                1,
                current_period=period,
                finished=True,
                packets=packets,
                lost_packets=lost,
                total_gap_ms=gap_ms,
                latest_losses=losses,
            )

    def close(self) -> None:
        pass


def _rows(key, count: int, **columns) -> pd.DataFrame:
    names = [field.split(" ")[0] for field in OUTPUT_SCHEMA.split(", ")]
    whole = dict.fromkeys(names) | dict(zip(names, key)) | columns
    return pd.DataFrame(whole, index=range(count))[names].astype({c: "Int64" for c in ("seq", "packets", "lost_packets")})


def drift_with_end(
    packets: DataFrame,
    event_time: str,
    idle_seconds: float,
    max_drift: float = 0.02,
    late_seconds: float = 1.0,
    keys: Sequence[str] = PACKET_KEYS,
) -> DataFrame:
    """Adaptive periods of a stream of packets, and a row with the totals of each key that has fallen silent.

    A key is finished when event time has passed its last packet by ``idle_seconds``; packets ``late_seconds`` behind
    the latest of earlier batches are dropped, as a watermark does.  Packets of one batch are put in order, batches must come
    in order.  The state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    timed = packets.withWatermark(event_time, f"{late_seconds} seconds").select(
        *keys, "seq", "node_ticks", "samples_in_packet", "period", event_time, F.unix_millis(event_time).alias("event_ms")
    )
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    processor = DriftProcessor(max_drift, int(idle_seconds * 1000))
    return timed.groupBy(*keys).transformWithStateInPandas(processor, OUTPUT_SCHEMA, "Append", "eventTime")
