import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushline.streaming import stateful, windows


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Three chunks of irregular length on disk, read as a stream one file at a time."""
    rng = np.random.default_rng(2)
    n = 300
    start = dt.datetime(2024, 1, 1)
    frame = pd.DataFrame({"event_id": np.arange(n), "stream_id": rng.integers(0, 3, n), "ts": [start + dt.timedelta(minutes=9 * i) for i in range(n)],
                          "score": np.round(rng.uniform(0, 10, n), 2), "is_anomaly": rng.random(n) < 0.2})
    frame["near"], frame["far"] = frame["score"] - 5, frame["score"] * 0.5 + rng.normal(size=n)
    folder = str(tmp_path_factory.mktemp("events"))
    df = spark.createDataFrame(frame)
    for low, high in ((0, 37), (37, 250), (250, n)):
        df.where(F.col("event_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return frame, df, stream


def state_loop(scores, high, low):
    state, out = 0, []
    for s in scores:
        state = 1 if s >= high else 0 if s < low else state
        out.append(state)
    return out


def test_hysteresis_batch_and_stream_agree_with_a_loop(events):
    frame, df, stream = events
    batch = windows.hysteresis(df, 8.0, 3.0).toPandas().sort_values("event_id")
    live = windows.run_to_table(stateful.alarm_states(stream, 8.0, 3.0)).toPandas().sort_values("event_id")
    for key, part in frame.groupby("stream_id"):
        want = state_loop(part["score"], 8.0, 3.0)
        assert batch[batch["stream_id"] == key]["alarm"].tolist() == want
        assert live[live["stream_id"] == key]["alarm"].tolist() == want
        onsets = [int(b > a) for a, b in zip([0, *want], want)]
        assert batch[batch["stream_id"] == key]["onset"].astype(int).tolist() == onsets


def test_causal_state_survives_chunks_and_restarts(events):
    frame, _, stream = events
    out = windows.run_to_table(stateful.causal_averages(stream, 0.9, 45 * 60.0)).toPandas().set_index("event_id")
    for _, part in frame.groupby("stream_id"):
        last, x, n, f = None, 0.0, 0.0, 0.0
        for row in part.itertuples():
            restart = last is None or (row.ts - last).total_seconds() > 45 * 60
            keep = 0.0 if restart else 0.9
            x = keep * x + (1 - keep) * row.near * row.far
            n = keep * n + (1 - keep) * row.near**2
            f = keep * f + (1 - keep) * row.far**2
            last = row.ts
            assert out.loc[row.event_id, "restarted"] == restart
            assert out.loc[row.event_id, "coherence"] == pytest.approx(min(1.0, x * x / (n * f + 1e-8)))


def test_watermarked_windows_equal_the_closed_batch_windows(events):
    frame, df, stream = events
    live = windows.run_to_table(windows.stream_window_scores(stream, "1 hour", "30 minutes", "20 minutes")).toPandas()
    batch = windows.window_scores(df, "1 hour", "30 minutes").toPandas()
    closed = batch[batch["window_end"] <= frame["ts"].max() - pd.Timedelta(minutes=20)]
    key = ["stream_id", "window_start"]
    a, b = live.sort_values(key).reset_index(drop=True), closed.sort_values(key).reset_index(drop=True)
    assert len(a) == len(b) > 0
    np.testing.assert_allclose(a["window_score"], b["window_score"])


def test_clip_aggregates(events):
    frame, df, _ = events
    got = windows.clip_aggregates(df, ["stream_id"], 3, 0.3, 4.0).toPandas().set_index("stream_id")
    for key, part in frame.groupby("stream_id"):
        s = part["score"].to_numpy()
        y = s[0]
        for v in s[1:]:
            y = 0.3 * v + 0.7 * y
        run = best = 0
        for v in s:
            run = run + 1 if v > 4.0 else 0
            best = max(best, run)
        row = got.loc[key]
        assert row["smoothed_score"] == pytest.approx(y) and row["longest_run"] == best
        assert row["topk_mean"] == pytest.approx(np.sort(s)[-3:].mean()) and row["mean_score"] == pytest.approx(s.mean())


def test_alert_statistics(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, i, start + dt.timedelta(hours=i), s, a) for i, (s, a) in enumerate([(9, False), (1, False), (1, True), (9, True), (1, False)])]
    df = spark.createDataFrame(
        [(a, b, c, float(d), e) for a, b, c, d, e in rows], "stream_id long, event_id long, ts timestamp, score double, is_anomaly boolean")
    row = windows.alert_statistics(windows.hysteresis(df, 8.0, 3.0)).first()
    assert (row["onsets"], row["false_alarms"], row["alert_delay_s"]) == (2, 1, 3600)
    assert row["false_alarms_per_hour"] == pytest.approx(0.25)
