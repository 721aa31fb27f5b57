"""Windowed scores, clip aggregation, hysteresis and alert statistics, in batch and streaming form.

Declared in the source material without an implementation; batch and stream share the same expressions.
Event times are TIMESTAMP_NTZ or TIMESTAMP columns; per-stream order is (ts, event_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushline.functions.numeric import d
from hushline.operators.ordered import ordered_positions
from hushline.session import new_folder

ORDER = ["ts", "event_id"]


def epoch_seconds(ts: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def window_scores(events: DataFrame, size: str = "1 second", hop: str = "250 milliseconds") -> DataFrame:
    """Mean score per stream and sliding window; works on batch and streaming frames alike."""
    grouped = events.groupBy("stream_id", F.window("ts", size, hop).alias("w"))
    out = grouped.agg(F.avg("score").alias("window_score"), F.count("*").alias("events"))
    return out.select("stream_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "window_score", "events")


def run_to_table(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a bounded stream to completion into a Parquet folder and read the folder back.

    Append mode: a window is written once, after the watermark has passed its end.
    """
    spark = stream.sparkSession
    target = folder or new_folder(spark, "stream")
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{target}/data")
        .option("checkpointLocation", f"{target}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/data")


def stream_window_scores(events: DataFrame, size: str, hop: str, delay: str) -> DataFrame:
    """Streaming twin of :func:`window_scores`.

    Late rule: an event older than the watermark (largest event time seen minus ``delay``) is dropped, and a
    window is final once the watermark passes its end.
    """
    return window_scores(events.withWatermark("ts", delay), size, hop)


# ---- clip aggregation --------------------------------------------------------------------------


def clip_aggregates(
    events: DataFrame, keys: list[str], top: int = 3, smoothing: float = 0.3, threshold: float = 100.0
) -> DataFrame:
    """Mean, max, top-k mean, exponentially smoothed last value and longest run above a threshold per key.

    Sequence positions come from per-hour offsets, so one very long key is never ordered in one task.
    """
    rows = events.withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")))
    placed = ordered_positions(rows, keys, "hour", ORDER, "pos")
    # Closed form of the smoothed value, seeded with the first score; weights fade below double range early.
    age = F.col("pos_count") - 1 - F.col("pos")
    weight = F.when(F.col("pos") == 0, d(1.0)).otherwise(d(smoothing)) * F.pow(d(1.0 - smoothing), age)
    base = placed.groupBy(*keys).agg(
        F.count("*").alias("windows"),
        F.avg("score").alias("mean_score"),
        F.max("score").alias("max_score"),
        F.sum(weight * F.col("score")).alias("smoothed_score"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score")))
    best = rows.select(*keys, "score").withColumn("_r", rank).where(F.col("_r") <= top)
    best = best.groupBy(*keys).agg(F.avg("score").alias("topk_mean"))
    above = placed.where(F.col("score") > d(threshold)).select(*keys, "hour", *ORDER, "pos")
    islands = ordered_positions(above, keys, "hour", ORDER, "among")
    runs = islands.groupBy(*keys, (F.col("pos") - F.col("among")).alias("island")).agg(F.count("*").alias("n"))
    longest = runs.groupBy(*keys).agg(F.max("n").alias("longest_run"))
    out = base.join(best, keys).join(longest, keys, "left")
    return out.withColumn("longest_run", F.coalesce("longest_run", F.lit(0).cast("bigint")))


# ---- hysteresis and alert statistics -----------------------------------------------------------


def hysteresis(events: DataFrame, high: float, low: float) -> DataFrame:
    """Alarm state per event: on from a score >= high until a score < low.

    The state is the last decisive flag.  Flags are filled inside (stream, day); each day starts from the last
    decisive flag of the days before, which is one small row per stream and day.
    """
    if low > high:
        raise ValueError("low must not exceed high")
    flag = F.when(F.col("score") >= d(high), 1).when(F.col("score") < d(low), 0)
    rows = events.withColumn("_day", F.to_date(F.col("ts").cast("timestamp_ntz"))).withColumn("_flag", flag)
    inside = Window.partitionBy("stream_id", "_day").orderBy(*ORDER)
    filled = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = rows.groupBy("stream_id", "_day").agg(
        F.max_by("_flag", F.when(F.col("_flag").isNotNull(), F.struct(*ORDER))).alias("_end")
    )
    before = Window.partitionBy("stream_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    local = rows.withColumn("_local", F.last("_flag", ignorenulls=True).over(filled))
    local = local.withColumn("_before", F.lag("_local").over(inside))
    joined = local.join(carried, ["stream_id", "_day"])
    state = lambda c: F.coalesce(F.col(c), F.col("_carry"), F.lit(0))
    return joined.select(
        *events.columns, state("_local").alias("alarm"), (state("_local") > state("_before")).alias("onset")
    )


def alert_statistics(states: DataFrame) -> DataFrame:
    """Per stream: onsets, false onsets per hour of span, and the delay from first anomaly to first alarm after it."""
    per_stream = states.groupBy("stream_id").agg(
        F.count("*").alias("events"),
        F.count_if("onset").alias("onsets"),
        F.count_if(F.col("onset") & ~F.col("is_anomaly")).alias("false_alarms"),
        F.min(epoch_seconds("ts")).alias("first_s"),
        F.max(epoch_seconds("ts")).alias("last_s"),
        F.min(F.when(F.col("is_anomaly"), epoch_seconds("ts"))).alias("anomaly_s"),
    )
    first = states.where(F.col("alarm") == 1).join(per_stream.select("stream_id", "anomaly_s"), "stream_id")
    first = first.where(epoch_seconds("ts") >= F.col("anomaly_s")).groupBy("stream_id").agg(
        F.min(epoch_seconds("ts")).alias("alarm_s")
    )
    hours = (F.col("last_s") - F.col("first_s")) / d(3600.0)
    return per_stream.join(first, "stream_id", "left").select(
        "stream_id", "events", "onsets", "false_alarms",
        F.when(hours > 0, F.col("false_alarms") / hours).alias("false_alarms_per_hour"),
        (F.col("alarm_s") - F.col("anomaly_s")).alias("alert_delay_s"),
    )
