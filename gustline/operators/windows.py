"""Tumbling windows of samples and the window documents they are stored as."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.operators.gaps import held_values
from gustline.operators.ordered import BLOCK_ROWS, block_of, running_totals
from gustline.session import broadcast_if_small, cut_lineage

PACKETS_PER_PART = 1 << 15


def with_window_number(df: DataFrame, time: str, size: float, starts: DataFrame | None = None) -> DataFrame:
    """Adds ``window_number`` counted from the session's start.

    ``starts`` (session_id, session_start) gives the starts; otherwise a session starts with its earliest row.
    """
    if starts is None:
        # written once: the rows are decoded for it a single time, and its size is counted on what was written
        starts = cut_lineage(df.groupBy("session_id").agg(F.min(time).alias("session_start")))
    number = F.floor((F.col(time) - F.col("session_start")) / F.lit(float(size))).cast("bigint")
    return (
        df.join(broadcast_if_small(starts), "session_id").withColumn("window_number", number).drop("session_start")
    )


def window_totals(df: DataFrame, time: Column, size: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates per event-time window and key; ``time`` is a timestamp and ``size`` an interval text."""
    totals = df.groupBy(F.window(time, size).alias("window"), *keys).agg(*aggregates)
    kept = [c for c in totals.columns if c != "window"]
    return totals.select(F.col("window.start").alias("window_start"), *kept)


def arrival_windows(
    df: DataFrame, arrival: str, size: float, keys: Sequence[str] = ("session_id",), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Windows that close on the first arrival ``size`` or more after their start, the next starting there."""
    keys = list(keys)
    sized = df.withColumn("_size", F.lit(float(size)))
    held = held_values(sized, keys, "seq", arrival, "_size", "elapsed", None, block_rows)
    closes = F.when(F.col("replaced"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return running_totals(held, keys, "seq", {"window_number": closes}, block_rows).select(
        *df.columns, "window_number"
    )


def window_documents(samples: DataFrame, packets_per_part: int = PACKETS_PER_PART) -> DataFrame:
    """JSON documents ``{node: {sensor: [[time, v0, ...], ...]}}`` per session, window and part.

    Needs session_id, window_number, node_id, sensor_name, seq, position,
    sample_time and sensor_value.  A part covers ``packets_per_part`` successive
    arrival numbers, so no document grows with its window or its busiest sensor.
    Samples are shuffled once: nodes and sensors of a part meet in one task.
    """
    document = ["session_id", "window_number", "part"]
    point = F.concat(F.array(F.col("sample_time")), F.col("sensor_value"))
    placed = samples.select(
        *[c for c in document if c != "part"],
        block_of("seq", packets_per_part).alias("part"),
        "node_id",
        "sensor_name",
        F.struct("seq", "position", point.alias("point")).alias("entry"),
    ).repartition(*document)
    per_sensor = placed.groupBy(*document, "node_id", "sensor_name").agg(
        F.array_sort(F.collect_list("entry")).getField("point").alias("points")
    )
    by_node = per_sensor.groupBy(*document, "node_id").agg(
        F.map_from_entries(F.collect_list(F.struct("sensor_name", "points"))).alias("sensors")
    )
    whole = by_node.groupBy(*document).agg(
        F.map_from_entries(F.collect_list(F.struct("node_id", "sensors"))).alias("window")
    )
    return whole.select(*document, F.to_json("window").alias("document"))


def stored_totals(stored: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Stored bytes and oldest window per key."""
    return stored.groupBy(*keys).agg(
        F.sum("bytes").alias("stored_bytes"),
        F.count("*").alias("windows"),
        F.min_by("path", "window_number").alias("oldest_path"),
    )


def retention(
    stored: DataFrame, byte_budget: int, keys: Sequence[str] = ("session_id",), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Marks which stored windows fit the budget, newest first.

    The newest window always stays.  ``near_limit`` flags rows at or beyond nine tenths of the budget.
    """
    keys = list(keys)
    sums = {"bytes_kept": F.col("bytes"), "_nth": F.lit(1).cast("bigint")}
    summed = running_totals(stored, keys, "window_number", sums, block_rows, descending=True)
    keep = (F.col("_nth") == 1) | (F.col("bytes_kept") <= byte_budget)
    return summed.withColumn("keep", keep).withColumn("near_limit", F.col("bytes_kept") >= F.lit(0.9 * byte_budget)).drop(
        "_nth"
    )
