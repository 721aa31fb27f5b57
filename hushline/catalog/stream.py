"""Queries over the event table in batch and streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushline.catalog.registry import query
from hushline.catalog.scores import rounded
from hushline.catalog.views import Views
from hushline.functions.numeric import d
from hushline.streaming import stateful, windows

SIZE, HOP, DELAY = "1 hour", "15 minutes", "10 minutes"
WINDOWS_SQL = """w AS (SELECT stream_id, score, ts, CAST(floor(epoch(ts) / 900e0) AS BIGINT) * 900 - i * 900 AS start_s FROM event_scores, unnest(range(0, 4)) u(i)),
    g AS (SELECT stream_id, start_s, start_s + 3600 AS end_s, avg(score) AS window_score, count(*) AS events FROM w GROUP BY stream_id, start_s)"""


def event_stream(v: Views) -> DataFrame:
    """The event table as a bounded stream in the event_scores shape."""
    schema = v.table("events").schema
    # One file per micro-batch bounds what a stateful operator sees at once.
    source = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1)
    raw = source.parquet(v.sf_dir)
    return raw.select(
        "event_id", F.col("user_id").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("score"),
        (F.col("event_type") == "error").alias("is_anomaly"),
        (F.col("value") - d(100.0)).alias("near"), (d(0.5) * F.col("value") + F.col("event_id") % 7).alias("far"),
    )


def timed(df: DataFrame) -> DataFrame:
    return rounded(
        df.select("stream_id", windows.epoch_seconds("window_start").alias("start_s"),
                  windows.epoch_seconds("window_end").alias("end_s"), "window_score", "events")
    )


@query(
    "d01_sliding_windows",
    "event_scores",
    f"WITH {WINDOWS_SQL} SELECT stream_id, start_s, end_s, round(window_score, 6) + 0e0 AS window_score, events FROM g",
)
def d01(v: Views) -> DataFrame:
    return timed(windows.window_scores(v.event_scores, SIZE, HOP))


@query(
    "d05_stream_windows_with_watermark",
    "event_scores",
    f"""WITH {WINDOWS_SQL} SELECT stream_id, start_s, end_s, round(window_score, 6) + 0e0 AS window_score, events FROM g
    WHERE end_s <= (SELECT epoch(max(ts)) - 600 FROM event_scores)""",
)
def d05(v: Views) -> DataFrame:
    stream = windows.stream_window_scores(event_stream(v), SIZE, HOP, DELAY)
    return timed(windows.run_to_table(stream))


@query(
    "d02_clip_aggregates",
    "event_scores",
    """WITH RECURSIVE n AS (SELECT stream_id, score, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS i FROM event_scores),
    sm AS (SELECT stream_id, i, score AS y FROM n WHERE i = 1 UNION ALL SELECT n.stream_id, n.i, 0.3e0 * n.score + 0.7e0 * sm.y FROM sm JOIN n ON n.stream_id = sm.stream_id AND n.i = sm.i + 1),
    ls AS (SELECT stream_id, max_by(y, i) AS smoothed FROM sm GROUP BY stream_id),
    tk AS (SELECT stream_id, avg(score) AS topk FROM (SELECT stream_id, score, row_number() OVER (PARTITION BY stream_id ORDER BY score DESC) AS r FROM n) WHERE r <= 3 GROUP BY stream_id),
    il AS (SELECT stream_id, i - row_number() OVER (PARTITION BY stream_id ORDER BY i) AS island FROM n WHERE score > 100),
    rn AS (SELECT stream_id, max(c) AS longest FROM (SELECT stream_id, island, count(*) AS c FROM il GROUP BY ALL) GROUP BY stream_id)
    SELECT stream_id, count(*) AS windows, round(avg(score), 6) + 0e0 AS mean_score, round(max(score), 6) + 0e0 AS max_score, round(max(smoothed), 6) + 0e0 AS smoothed_score,
      round(max(topk), 6) + 0e0 AS topk_mean, coalesce(max(longest), 0) AS longest_run FROM n JOIN ls USING (stream_id) JOIN tk USING (stream_id) LEFT JOIN rn USING (stream_id) GROUP BY stream_id""",
)
def d02(v: Views) -> DataFrame:
    return rounded(windows.clip_aggregates(v.event_scores, ["stream_id"]))


HYSTERESIS_SQL = """fl AS (SELECT *, CASE WHEN score >= 120 THEN 1 WHEN score < 40 THEN 0 END AS flag FROM event_scores),
    hs AS (SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS alarm FROM fl),
    st AS (SELECT *, alarm > coalesce(lag(alarm) OVER (PARTITION BY stream_id ORDER BY ts, event_id), 0) AS onset FROM hs)"""


@query(
    "d03_alarm_hysteresis",
    "event_scores",
    f"WITH {HYSTERESIS_SQL} SELECT stream_id, event_id, alarm, onset FROM st",
)
def d03(v: Views) -> DataFrame:
    return windows.hysteresis(v.event_scores, 120.0, 40.0).select("stream_id", "event_id", "alarm", "onset")


@query(
    "d03_stream_hysteresis",
    "event_scores",
    f"WITH {HYSTERESIS_SQL} SELECT stream_id, event_id, alarm FROM st",
)
def d03_stream(v: Views) -> DataFrame:
    states = stateful.alarm_states(event_stream(v), 120.0, 40.0)
    return windows.run_to_table(states).select("stream_id", "event_id", "alarm")


@query(
    "d04_stream_causal_state",
    sql="""WITH RECURSIVE n AS (SELECT event_id, user_id AS stream_id, ts, value - 100e0 AS a, 0.5e0 * value + event_id % 7 AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
        coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400000000, true) AS restarted FROM events),
    s AS (SELECT stream_id, event_id, i, restarted, a*b AS x, a*a AS p, b*b AS q FROM n WHERE i = 1
      UNION ALL SELECT n.stream_id, n.event_id, n.i, n.restarted, CASE WHEN n.restarted THEN a*b ELSE 0.95e0 * x + 0.05e0 * a*b END,
        CASE WHEN n.restarted THEN a*a ELSE 0.95e0 * p + 0.05e0 * a*a END, CASE WHEN n.restarted THEN b*b ELSE 0.95e0 * q + 0.05e0 * b*b END
      FROM s JOIN n ON n.stream_id = s.stream_id AND n.i = s.i + 1)
    SELECT stream_id, event_id, restarted, round(least(1e0, x*x / (p*q + 1e-8)), 6) + 0e0 AS coherence FROM s""",
)
def d04(v: Views) -> DataFrame:
    states = stateful.causal_averages(event_stream(v), 0.95, 86400.0)
    return rounded(windows.run_to_table(states).select("stream_id", "event_id", "restarted", "coherence"))


@query(
    "d06_alert_statistics",
    "event_scores",
    f"""WITH {HYSTERESIS_SQL}, sec AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM st),
    p AS (SELECT stream_id, count(*) AS events, count(*) FILTER (onset) AS onsets, count(*) FILTER (onset AND NOT is_anomaly) AS false_alarms, max(s) - min(s) AS span, min(s) FILTER (is_anomaly) AS anomaly_s FROM sec GROUP BY stream_id),
    f AS (SELECT sec.stream_id, min(s) AS alarm_s FROM sec JOIN p USING (stream_id) WHERE alarm = 1 AND s >= anomaly_s GROUP BY sec.stream_id)
    SELECT stream_id, events, onsets, false_alarms, round(false_alarms / nullif(span / 3600e0, 0), 6) + 0e0 AS false_alarms_per_hour, alarm_s - anomaly_s AS alert_delay_s FROM p LEFT JOIN f USING (stream_id)""",
)
def d06(v: Views) -> DataFrame:
    return rounded(windows.alert_statistics(windows.hysteresis(v.event_scores, 120.0, 40.0)))
