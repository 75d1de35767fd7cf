"""Framing of sessions that are still open.

Between micro-batches a session carries the number of its packets and the bytes
of the packet that its end has cut off so far; these stand before the bytes that
come next, so packets, their numbers and their times are those of the whole
session, however it is spread over batches and ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.session import cut_lineage, join_with_nulls
from gustline.sources import captures
from gustline.streaming.batches import BatchWriter
from gustline.streaming.state import read_state, write_state

KEYS = ["session_id"]
STATE_SCHEMA = "session_id string, packets bigint, raw binary, left bigint, arrived double"


def _held_back(state: DataFrame) -> DataFrame:
    """Cut-off packets as chunks that come before all others of their session."""
    return state.where("raw IS NOT NULL").select(
        "session_id",
        F.lit("").alias("path"),
        F.lit(0).cast("bigint").alias("offset"),
        F.col("left").alias("file_length"),
        "arrived",
        F.col("raw").alias("content"),
    )


def frame_stream(state_path: str, write: BatchWriter, origins: DataFrame, seconds_per_byte: float = 0.0) -> BatchWriter:
    """Handler for micro-batches of byte ranges; ``write`` gets the packets that each batch completes."""

    def handle(batch: DataFrame, number: int) -> None:
        kept = batch.persist()  # ranges are read once, whatever the passes over them
        try:
            follow(kept, number)
        finally:
            kept.unpersist()

    def follow(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = cut_lineage(batch.select("session_id").distinct())
        state = read_state(spark, state_path, STATE_SCHEMA, KEYS, number)
        state = cut_lineage(join_with_nulls(state, touched, KEYS, "left_semi"))
        chunks = batch.select(*captures.CHUNK_COLUMNS).unionByName(_held_back(state))
        found = cut_lineage(captures.framed(chunks, origins, seconds_per_byte, carried=state))
        write(found.where("NOT cut_off").select(*captures.PACKET_COLUMNS), number)
        ended = found.where("cut_off").select("session_id", F.col("seq").alias("_cut"), "raw", "left", "arrived")
        whole = found.where("NOT cut_off").groupBy("session_id").agg((F.max("seq") + 1).alias("_whole"))
        after = join_with_nulls(touched, state.select("session_id", "packets"), KEYS, "left")
        after = join_with_nulls(join_with_nulls(after, whole, KEYS, "left"), ended, KEYS, "left")
        packets = F.coalesce("_cut", "_whole", "packets", F.lit(0).cast("bigint")).alias("packets")
        write_state(after.select("session_id", packets, "raw", "left", "arrived"), state_path, STATE_SCHEMA, KEYS, number)

    return handle


def close_sessions(
    spark: SparkSession, state_path: str, origins: DataFrame, sessions: DataFrame, number: int, seconds_per_byte: float = 0.0
) -> DataFrame:
    """Ends ``sessions`` (session_id) as batch ``number``, after their last one: gives the packets that stay cut off.

    State of ended sessions goes with the next snapshot; bytes that come later would begin a new count.
    """
    state = read_state(spark, state_path, STATE_SCHEMA, KEYS, number)
    state = cut_lineage(join_with_nulls(state, sessions.select(*KEYS).distinct(), KEYS, "left_semi"))
    chunks = _held_back(state)
    cut_off = cut_lineage(captures.framed(chunks, origins, seconds_per_byte, carried=state).select(*captures.PACKET_COLUMNS))
    write_state(state.withColumn("finished", F.lit(True)), state_path, STATE_SCHEMA, KEYS, number)
    return cut_off
