"""Sample times as the bench script of the laboratory stamps them: a packet is stamped when the next one arrives.

Samples run back from the end of their packet.  An inertial packet ends when the
next one of its sensor arrives, and its samples are as far apart as the adaptive
period says by then; a microphone packet ends where its count since the first
says; any other ends at its sensor's ideal clock, which a lost packet sets anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline import catalogue as cat
from gustline.operators import clock, gaps
from gustline.operators.ordered import BLOCK_ROWS, next_row

ENDS = ["end_time", "sample_period", "is_first", "lost", "gap_ms"]


def packet_ends(
    packets: DataFrame,
    slack_seconds: float = 0.005,
    max_drift: float = 0.02,
    block_rows: int = BLOCK_ROWS,
    keys: Sequence[str] = gaps.PACKET_KEYS,
) -> DataFrame:
    """Adds end_time (seconds of the node clock), sample_period, is_first, lost and gap_ms to every sensor packet.

    ``packets``: the keys, seq, node_ticks, samples_in_packet and period.  The script never writes the last packet of
    a sensor, as nothing follows it; here an inertial one ends its own length after its clock.
    """
    columns = packets.columns
    inertial = F.col("sensor_name").isin(cat.IMU_SENSORS)
    hertz = F.lit(cat.NODE_CLOCK_HZ)
    length = F.col("samples_in_packet") * F.col("sample_period")

    drifting = gaps.period_drift(packets.where(inertial), max_drift, block_rows, keys)
    followed = next_row(drifting, keys, "seq", {"node_ticks": "_next"}, block_rows)
    followed = followed.withColumn("sample_period", F.col("current_period"))
    own_end = F.col("node_ticks") / hertz + length
    imu = followed.withColumn("end_time", F.coalesce(F.col("_next") / hertz, own_end)).select(*columns, *ENDS)

    microphone = F.col("sensor_name") == cat.MICROPHONE
    running = clock.free_running_times(packets.where(microphone), list(keys), "samples_in_packet", "period", block_rows)
    running = running.withColumn("sample_period", F.col("period"))
    mics = running.select(
        *columns,
        (F.col("free_time") + length).alias("end_time"),
        "sample_period",
        (F.col("packet_ordinal") == 1).alias("is_first"),
        F.lit(False).alias("lost"),
        F.lit(None).cast("double").alias("gap_ms"),
    )

    other = packets.where(~F.coalesce(inertial | microphone, F.lit(False)))
    synchronised = gaps.lost_sets(other, slack_seconds, block_rows, keys).select(
        *columns, F.col("ideal_time").alias("end_time"), F.col("period").alias("sample_period"), "is_first", "lost", "gap_ms"
    )
    return imu.unionByName(mics).unionByName(synchronised)


def lab_times(samples: DataFrame) -> DataFrame:
    """Adds ``sample_time`` to decoded samples that carry the packet's end_time, sample_period and samples_in_packet."""
    back = F.col("samples_in_packet") - F.col("position")
    return samples.withColumn("sample_time", F.col("end_time") - back * F.col("sample_period"))
