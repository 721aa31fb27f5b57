"""Stateful streaming operators: causal averages with reset after an interruption, and alarm hysteresis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

AVERAGE_OUTPUT = "stream_id long, event_id long, ts timestamp, coherence double, restarted boolean"
AVERAGE_STATE = "last_us long, cross double, near double, far double"
ALARM_OUTPUT = "stream_id long, event_id long, ts timestamp, alarm int"
ALARM_STATE = "alarm int"


def _in_order(chunks: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """Rows of one key in this micro-batch; the batch size is bounded by the source's rate limits."""
    return pd.concat(list(chunks), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")


def causal_averages(events: DataFrame, alpha: float = 0.95, gap_seconds: float = 3600.0, eps: float = 1.0e-8) -> DataFrame:
    """Causal coherence of (near, far) per stream, whatever the chunking of the input.

    The state is three numbers per stream.  A gap longer than ``gap_seconds`` restarts the averages.  Rows of a
    micro-batch are taken in (ts, event_id) order; no later row ever changes an earlier output.
    """
    limit_us = int(gap_seconds * 1e6)

    def follow(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _in_order(chunks)
        last, cross, near, far = state.get if state.exists else (None, 0.0, 0.0, 0.0)
        stamps = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        a, b = rows["near"].to_numpy(float), rows["far"].to_numpy(float)
        out, restarts = np.empty(len(rows)), np.zeros(len(rows), dtype=bool)
        for i, stamp in enumerate(stamps):
            restarts[i] = last is None or stamp - last > limit_us
            keep = 0.0 if restarts[i] else alpha
            cross = keep * cross + (1.0 - keep) * a[i] * b[i]
            near = keep * near + (1.0 - keep) * a[i] * a[i]
            far = keep * far + (1.0 - keep) * b[i] * b[i]
            out[i] = min(1.0, cross * cross / (near * far + eps))
            last = int(stamp)
        state.update((last, cross, near, far))
        yield pd.DataFrame(
            {"stream_id": key[0], "event_id": rows["event_id"].to_numpy(), "ts": rows["ts"].to_numpy(),
             "coherence": out, "restarted": restarts}
        )

    return events.groupBy("stream_id").applyInPandasWithState(
        follow, AVERAGE_OUTPUT, AVERAGE_STATE, "append", GroupStateTimeout.NoTimeout
    )


def alarm_states(events: DataFrame, high: float, low: float) -> DataFrame:
    """Streaming twin of the batch hysteresis: the state is one flag per stream."""

    def follow(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _in_order(chunks)
        start = state.get[0] if state.exists else 0
        score = rows["score"]
        flag = pd.Series(np.where(score >= high, 1.0, np.where(score < low, 0.0, np.nan)))
        alarm = flag.ffill().fillna(start).astype(int).to_numpy()
        state.update((int(alarm[-1]),))
        yield pd.DataFrame(
            {"stream_id": key[0], "event_id": rows["event_id"].to_numpy(), "ts": rows["ts"].to_numpy(), "alarm": alarm}
        )

    return events.groupBy("stream_id").applyInPandasWithState(
        follow, ALARM_OUTPUT, ALARM_STATE, "append", GroupStateTimeout.NoTimeout
    )
