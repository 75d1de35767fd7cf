"""Capture files of raw bytes to packet records.

A capture session is a folder of files that together hold one byte stream, in
file-name order; a packet may run over from one file to the next.  Framing is
sequential (a packet's length says where the next one starts), yet chunks of the
stream, whole files or byte ranges of them, are framed in parallel:

1. every chunk on its own yields, for each of the 258 states a stream can be in
   at its start, the state at its end and the number of packets begun;
2. such tables compose, so neighbours are folded into one in a tree of bounded
   fan-in, and the state at every chunk's start comes back down the same tree;
3. every chunk is framed from its now known state, with the few bytes of later
   chunks that its last packet needs.

States: 0-255 = so many bytes of a running packet are still to come,
256 = a length byte is due, 257 = a type and a length byte are due.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline import catalogue as cat
from gustline.session import broadcast_if_small, cut_lineage, join_with_nulls, literal_table

STATES = 258
LENGTH_DUE, HEADER_DUE = 256, 257
HEAD_BYTES = 257
CAPTURE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
_FRAMED_SCHEMA = (
    "session_id string, seq bigint, leading_byte int, packet_type int, packet binary, frame_length int, "
    "packet_timestamp double, cut_off boolean, raw binary, left bigint, arrived double"
)
PACKET_COLUMNS = [
    "session_id", "seq", "packet_origin", "packet_type", "packet", "frame_length", "packet_timestamp",
]
CHUNK_COLUMNS = ["session_id", "path", "offset", "file_length", "arrived", "content"]
_CHUNKS_PER_BROADCAST = 200_000


def leading_bytes(
    spark: SparkSession,
    node_ids: list[str],
    packet_key: int = cat.PACKET_KEY,
    packet_key_offset: int = cat.PACKET_KEY_OFFSET,
) -> DataFrame:
    """Leading byte of every origin; a node whose byte equals the base station's takes it over."""
    origins = {packet_key: cat.BASE_STATION_ID}
    origins.update({packet_key_offset + int(node): str(node) for node in node_ids})
    return literal_table(spark, sorted(origins.items()), "leading_byte int, packet_origin string")


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Capture files; the session is the name of the folder they lie in."""
    return _as_captures(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def stream_captures(spark: SparkSession, path: str) -> DataFrame:
    """Whole capture files as they appear, for sessions whose folder is moved into place when it is complete.

    Open sessions are followed by :func:`gustline.sources.ranges.stream_ranges`.
    """
    reader = spark.readStream.format("binaryFile").schema(CAPTURE_SCHEMA)
    return _as_captures(reader.option("recursiveFileLookup", "true").load(path))


def _as_captures(files: DataFrame) -> DataFrame:
    return files.select(
        F.element_at(F.split("path", "/"), -2).alias("session_id"), "path", "modificationTime", "content"
    )


def _starts(content: bytes, leaders: frozenset[int]) -> np.ndarray:
    """Positions of all leading bytes; the end of the content closes the list."""
    data = np.frombuffer(content, dtype=np.uint8)
    wanted = np.zeros(256, dtype=bool)
    wanted[list(leaders)] = True
    return np.append(np.flatnonzero(wanted[data]), len(data))


def _enter(content: bytes, state: int) -> int | None:
    """Where framing begins in a file entered in ``state``; None if the file ends within the header."""
    if state < LENGTH_DUE:
        return state
    at = state - LENGTH_DUE
    return at + 1 + content[at] if at < len(content) else None


def _end_state(content: bytes, at: int) -> int | None:
    """State at the end of the file of a packet whose leading byte is at ``at``; None if it ends inside."""
    left = len(content) - at - 3
    if left < 0:
        return LENGTH_DUE if left == -1 else HEADER_DUE
    over = content[at + 2] - left
    return over if over > 0 else None


def _skip_whole_packets(content: bytes, at: int, leaders: frozenset[int]) -> tuple[int, int]:
    """Position after the unbroken run of whole packets that starts at ``at``, and their number."""
    last, number = len(content) - 2, 0
    while at < last and content[at] in leaders:
        following = at + 3 + content[at + 2]
        if following > len(content):
            break
        at, number = following, number + 1
    return at, number


def transfer(content: bytes, leaders: frozenset[int]) -> tuple[list[int], list[int]]:
    """State at the end of a chunk, and packets begun in it, for every state at its start.

    All states walk at once, lowest position first.  Walks that meet go on as
    one, which after a few packets leaves a single walk over the chunk.
    """
    ends, counts = [0] * STATES, [0] * STATES
    # position -> states that walk there, and packets that all of them have begun since they met
    waiting: dict[int, tuple[list[int], int]] = {}

    def settle(states: list[int], begun: int) -> None:
        if begun:
            for state in states:
                counts[state] += begun

    for state in range(STATES):
        at = _enter(content, state)
        if at is None:
            ends[state] = state - len(content)
        elif at >= len(content):
            ends[state] = at - len(content)
        else:
            waiting.setdefault(at, ([], 0))[0].append(state)
    starts = _starts(content, leaders)
    queue = list(waiting)
    heapq.heapify(queue)
    index = 0
    while queue:
        at = heapq.heappop(queue)
        states, begun = waiting.pop(at)
        if not queue:
            at, skipped = _skip_whole_packets(content, at, leaders)
            begun += skipped
        if at < len(content) and content[at] not in leaders:
            index += int(np.searchsorted(starts[index:], at))
            at = int(starts[index])
        if at == len(content):
            settle(states, begun)
            continue
        begun += 1
        end = _end_state(content, at)
        following = at + 3 + content[at + 2] if end is None else len(content)
        if following == len(content):
            settle(states, begun)
            for state in states:
                ends[state] = end or 0
        elif following in waiting:
            settle(states, begun)
            settle(*waiting[following])
            waiting[following] = (waiting[following][0] + states, 0)
        else:
            heapq.heappush(queue, following)
            waiting[following] = (states, begun)
    return ends, counts


def transfer_table(content: bytes, leaders: frozenset[int]) -> list[int]:
    """State at the end of a chunk for every state at its start."""
    return transfer(content, leaders)[0]


def frame(content: bytes, tail: bytes, state: int, leaders: frozenset[int]) -> Iterator[tuple]:
    """Packets whose leading byte lies in ``content``: (leading byte, type, declared length, payload, end, start).

    A header or payload that the stream's end cuts off gives a shorter payload;
    a missing type or length byte gives type -1.
    """
    at = _enter(content, state)
    if at is None:
        return
    starts = _starts(content, leaders)
    whole = content + tail
    index = 0
    while at < len(content):
        if content[at] not in leaders:
            index += int(np.searchsorted(starts[index:], at))
            at = int(starts[index])
            if at == len(content):
                return
        if at + 2 >= len(whole):
            yield content[at], -1, None, b"", len(whole), at
            return
        length = whole[at + 2]
        end = at + 3 + length
        yield content[at], whole[at + 1], length, whole[at + 3 : end], end, at
        at = end


#: Chunks whose tables are composed into one.
FAN = 256
_CHUNK_KEYS = "session_id string, path string, offset bigint"
_TABLE = "ends array<int>, counts array<bigint>, head binary"


def _compose(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Tables of chunks in order, as the table of all of them together."""
    state, counts, head = np.arange(STATES), np.zeros(STATES, np.int64), b""
    for ends, begun, own in zip(pdf["ends"], pdf["counts"], pdf["head"]):
        counts = counts + np.asarray(begun)[state]
        state = np.asarray(ends)[state]
        if len(head) < HEAD_BYTES:
            head = (head + bytes(own))[:HEAD_BYTES]
    return state, counts, head


def _fold(tables: DataFrame) -> DataFrame:
    """One row for each run of FAN neighbours."""
    fan = FAN

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        state, counts, head = _compose(pdf)
        first = pdf.iloc[0]
        return pd.DataFrame(
            {"session_id": [first.session_id], "place": [first.place // fan], "ends": [state], "counts": [counts], "head": [head]}
        )

    block = F.floor(F.col("place") / fan).alias("_block")
    return tables.groupBy("session_id", block).applyInPandas(fold, f"session_id string, place bigint, {_TABLE}")


def _unfold(tables: DataFrame, known: DataFrame) -> DataFrame:
    """Where each row of ``tables`` starts, from where the runs that it belongs to start."""

    def unfold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place").reset_index(drop=True)
        state, begun, after = int(pdf["_state"][0]), int(pdf["_begun"][0]), bytes(pdf["_tail"][0])
        states, numbers, tails = [], [], []
        for ends, counts, head in zip(pdf["ends"], pdf["counts"], pdf["head"]):
            states.append(state)
            numbers.append(begun)
            begun, state = begun + int(counts[state]), int(ends[state])
        for head in reversed(list(pdf["head"])):
            tails.append(after)
            after = (bytes(head) + after)[:HEAD_BYTES]
        return pdf[["session_id", "place"]].assign(state=states, begun=numbers, tail=tails[::-1])

    start = known.select(
        F.col("session_id").alias("_session"),
        F.col("place").alias("_block"),
        F.col("state").alias("_state"),
        F.col("begun").alias("_begun"),
        F.col("tail").alias("_tail"),
    )
    block = F.floor(F.col("place") / FAN)
    same = F.col("session_id").eqNullSafe(F.col("_session")) & (block == F.col("_block"))
    grouped = tables.join(start, same).groupBy("_session", "_block")
    return grouped.applyInPandas(unfold, "session_id string, place bigint, state int, begun bigint, tail binary")


def chunk_starts(chunks: DataFrame, leaders: frozenset[int], carried: DataFrame | None = None) -> DataFrame:
    """session_id, path, offset, state, begun (packets of the session before) and tail (bytes after) of every chunk.

    ``carried`` (session_id, packets) tells how many packets were framed before.  No task gets more than FAN tables,
    whatever the length of a session; only names and offsets of chunks are numbered as a whole.
    """

    def tabulate(batches):
        for pdf in batches:
            contents = [bytes(c) for c in pdf["content"]]
            found = [transfer(c, leaders) for c in contents]
            yield pdf[["session_id", "path", "offset"]].assign(
                ends=[e for e, _ in found], counts=[n for _, n in found], head=[c[:HEAD_BYTES] for c in contents]
            )

    narrow = chunks.select("session_id", "path", "offset", "content")
    tables = cut_lineage(narrow.mapInPandas(tabulate, f"{_CHUNK_KEYS}, {_TABLE}"))
    order = Window.partitionBy("session_id").orderBy("path", "offset")
    places = tables.select("session_id", "path", "offset").withColumn("place", F.row_number().over(order).cast("bigint") - 1)
    numbered = cut_lineage(join_with_nulls(tables, places, ["session_id", "path", "offset"]))
    levels = [numbered]
    while (levels[-1].agg(F.max("place")).first()[0] or 0) >= FAN:
        levels.append(cut_lineage(_fold(levels[-1])))
    sessions = levels[-1].select("session_id").distinct()
    begun = F.lit(0).cast("bigint")
    if carried is not None:
        sessions = join_with_nulls(sessions, carried.select("session_id", "packets"), ["session_id"], "left")
        begun = F.coalesce("packets", begun)
    known = sessions.select(
        "session_id", F.lit(0).cast("bigint").alias("place"), F.lit(0).alias("state"), begun.alias("begun"), F.lit(b"").alias("tail")
    )
    for level in reversed(levels):
        known = cut_lineage(_unfold(level, known))
    named = numbered.select("session_id", "path", "offset", "place")
    return join_with_nulls(named, known, ["session_id", "place"]).drop("place")


def framed(
    chunks: DataFrame,
    origins: DataFrame,
    seconds_per_byte: float = 0.0,
    packets_per_batch: int = 20_000,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Packets of chunks as :func:`frame_chunks` has them, and whether a session's bytes end inside one.

    Such a packet is ``cut_off``; its ``raw`` bytes so far begin ``left`` bytes before the end of a file that was
    complete at ``arrived``.
    """
    # at most 256 leading bytes exist
    leaders = frozenset(row["leading_byte"] for row in origins.select("leading_byte").collect())
    starts = cut_lineage(chunk_starts(chunks, leaders, carried))
    placed = join_with_nulls(chunks, broadcast_if_small(starts, _CHUNKS_PER_BROADCAST), ["session_id", "path", "offset"])

    def emit(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                content, tail, rows = bytes(row.content), bytes(row.tail), []
                left = row.file_length - row.offset
                numbered = enumerate(frame(content, tail, int(row.state), leaders), int(row.begun))
                for seq, (leading, kind, length, payload, end, start) in numbered:
                    cut_off = length is None or len(payload) < length
                    raw = (content + tail)[start:] if cut_off else None
                    stamp = row.arrived - (left - end) * seconds_per_byte
                    rows.append(
                        (row.session_id, seq, leading, kind, payload, length, stamp, cut_off, raw, left - start, row.arrived)
                    )
                    if len(rows) == packets_per_batch:
                        yield _packet_frame(rows)
                        rows = []
                if rows:
                    yield _packet_frame(rows)

    packets = placed.select("session_id", "offset", "file_length", "arrived", "content", "state", "begun", "tail")
    return packets.mapInPandas(emit, _FRAMED_SCHEMA).join(F.broadcast(origins), "leading_byte")


def frame_chunks(
    chunks: DataFrame, origins: DataFrame, seconds_per_byte: float = 0.0, packets_per_batch: int = 20_000
) -> DataFrame:
    """Packet records of chunks of capture sessions.

    ``chunks``: session_id, path, offset, file_length, arrived (posix seconds of the file's last byte), content.
    Bytes that are no origin's leading byte are skipped one by one.  ``seq`` numbers the packets of a session from 0.
    A packet's time runs back from the arrival of the file that it begins in, ``seconds_per_byte`` for each byte.  A
    packet that the end of a session cuts off is a short one.
    """
    return framed(chunks, origins, seconds_per_byte, packets_per_batch).select(*PACKET_COLUMNS)


def frame_captures(
    captures: DataFrame,
    origins: DataFrame,
    seconds_per_byte: float = 0.0,
    packets_per_batch: int = 20_000,
) -> DataFrame:
    """Packet records of whole capture files: session_id, path, modificationTime, content.

    Files are rows here, so they must fit Spark's limit of 2 GB; larger ones, and open sessions, are read in ranges
    (:mod:`gustline.sources.ranges`).
    """
    chunks = captures.select(
        "session_id",
        "path",
        F.lit(0).cast("bigint").alias("offset"),
        F.octet_length("content").cast("bigint").alias("file_length"),
        (F.unix_micros("modificationTime") / 1e6).alias("arrived"),
        "content",
    )
    return frame_chunks(chunks, origins, seconds_per_byte, packets_per_batch)


def _packet_frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["session_id", "seq", "leading_byte", "packet_type", "packet", "frame_length", "packet_timestamp"]
    frame_ = pd.DataFrame(rows, columns=[*names, "cut_off", "raw", "left", "arrived"])
    return frame_.assign(frame_length=frame_["frame_length"].astype("Int32"))
