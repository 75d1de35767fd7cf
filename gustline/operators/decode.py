"""Packet payloads to samples.

A :class:`Layout` says where every sample of one packet type lies.  Blocks of
samples are decoded by an Arrow UDF that gathers bytes of a whole batch with
numpy; one output row per sample instant carries an array of channels, never one
row per channel.  ``decode_natively`` is the same in plain Spark expressions and
serves as its cross-check.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline import catalogue as cat
from gustline.functions import binary
from gustline.operators.ordered import running_totals

SAMPLE_TYPE = "array<struct<sensor_name:string,position:int,sensor_value:array<double>>>"


@dataclass(frozen=True)
class Layout:
    """Byte offsets of one sensor in one packet type: ``offsets[sample][channel]``.

    ``kind`` is ``uint``, ``int`` or ``float``, one for all channels or one per
    channel, and ``width`` likewise.  ``channels`` pads with zeros when the
    sensor has more channels than the packet fills.
    """

    packet_type_name: str
    sensor_name: str
    offsets: tuple[tuple[int, ...], ...]
    width: int | tuple[int, ...]
    kind: str | tuple[str, ...]
    endian: str = "little"
    divisor: float = 1.0
    channels: int = 0
    node_id: str | None = None

    def columns(self) -> list[tuple[int, str]]:
        filled = len(self.offsets[0])
        widths = self.width if isinstance(self.width, tuple) else (self.width,) * filled
        kinds = self.kind if isinstance(self.kind, tuple) else (self.kind,) * filled
        return list(zip(widths, kinds))

    @property
    def number_of_channels(self) -> int:
        return max(self.channels, len(self.offsets[0]))

    @property
    def min_bytes(self) -> int:
        return max(start + width for row in self.offsets for start, (width, _) in zip(row, self.columns()))


def _grid(samples: int, channels: int, offset) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(offset(s, c) for c in range(channels)) for s in range(samples))


def layouts(
    number_of_sensors: dict[str, int] | None = None,
    samples_per_packet: dict[str, int] | None = None,
    endian: str = "little",
    node_id: str | None = None,
) -> list[Layout]:
    """Layouts of all packet types for given sensor counts; the defaults are those of the catalogue."""
    channels = {**cat.NUMBER_OF_SENSORS, **(number_of_sensors or {})}
    samples = {**cat.SAMPLES_PER_PACKET, **(samples_per_packet or {})}
    shared = {"endian": endian, "node_id": node_id}

    baros = channels["Baros_P"]
    diff = channels["Diff_Baros"]
    mic_half = channels["Mics"] // 2
    # microphones: groups of twenty 24-bit values hold two instants of both halves of the array, always big-endian
    mic_offsets = _grid(
        2 * (samples["Mics"] // 2),
        2 * mic_half,
        lambda s, c: 3 * (20 * (s // 2) + 5 * (s % 2) + 10 * (c // mic_half) + c % mic_half),
    )
    imu = [
        Layout(packet, sensor, _grid(samples["Acc"], 3, lambda s, c: 6 * s + 2 * c), 2, "int", **shared)
        for packet, sensor in [("IMU Accel", "Acc"), ("IMU Gyro", "Gyro"), ("IMU Magnetometer", "Mag")]
    ]
    return [
        Layout("Abs. baros", "Baros_P", _grid(samples["Baros_P"], baros, lambda s, c: 6 * c), 4, "uint", **shared),
        Layout("Abs. baros", "Baros_T", _grid(samples["Baros_P"], baros, lambda s, c: 6 * c + 4), 2, "int", **shared),
        Layout(
            "Diff. baros",
            "Diff_Baros",
            _grid(samples["Diff_Baros"], diff, lambda s, c: 2 * (diff * s + c)),
            2,
            "uint",
            **shared,
        ),
        Layout("Mic 0", "Mics", mic_offsets, 3, "int", endian="big", channels=channels["Mics"], node_id=node_id),
        *imu,
        Layout(
            "Constat",
            "Constat",
            _grid(samples["Constat"], 4, lambda s, c: 10 * s + (0, 4, 5, 6)[c]),
            (4, 1, 1, 4),
            ("float", "int", "int", "uint"),
            **shared,
        ),
        Layout(
            "Analog Vbat",
            "Analog Vbat",
            _grid(samples["Analog Vbat"], 1, lambda s, c: 4 * s),
            4,
            "uint",
            divisor=1e6,
            channels=channels["Analog Vbat"],
            **shared,
        ),
    ]


def _numbers(payloads: np.ndarray, layout: Layout) -> np.ndarray:
    """(rows, samples, channels) values of a (rows, bytes) block."""
    offsets = np.asarray(layout.offsets)
    out = np.zeros((len(payloads), len(offsets), layout.number_of_channels))
    for channel, (width, kind) in enumerate(layout.columns()):
        steps = np.arange(width) if layout.endian == "little" else np.arange(width)[::-1]
        picked = payloads[:, offsets[:, channel, None] + steps]
        if kind == "float":
            with np.errstate(invalid="ignore"):  # signalling NaN become quiet ones
                values = np.ascontiguousarray(picked).view("<f4")[..., 0].astype(float)
        else:
            values = (picked.astype(np.int64) << (8 * np.arange(width))).sum(axis=-1)
            if kind == "int":
                values -= (values >> (8 * width - 1)) << (8 * width)
        out[:, :, channel] = values / layout.divisor if layout.divisor != 1.0 else values
    return out


def _payload_block(packets: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` bytes of the given rows; rows are known to be long enough."""
    chosen = packets.take(pa.array(rows))
    starts = np.frombuffer(chosen.buffers()[1], dtype=np.int32)[chosen.offset : chosen.offset + len(rows)]
    data = np.frombuffer(chosen.buffers()[2], dtype=np.uint8)
    if len(rows) and (np.diff(starts) == starts[1] - starts[0] if len(rows) > 1 else np.array([True])).all():
        stride = int(starts[1] - starts[0]) if len(rows) > 1 else size
        whole = data[starts[0] : starts[0] + stride * (len(rows) - 1) + size]
        return np.lib.stride_tricks.as_strided(whole, (len(rows), size), (stride, 1), writeable=False)
    return data[starts[:, None] + np.arange(size)]


def _samples_of(count: int, packets: pa.Array, groups: list[tuple[np.ndarray, list[Layout]]]) -> pa.Array:
    """Samples of ``count`` packets, those of each group of rows by its layouts."""
    sensor_parts, position_parts, value_parts, length_parts = [], [], [], []
    counts = np.zeros(count, dtype=np.int64)
    order = []
    for rows, members in groups:
        block = _payload_block(packets, rows, max(m.min_bytes for m in members))
        for member in members:
            values = _numbers(block, member)
            n_rows, n_samples, n_channels = values.shape
            sensor_parts.append(pa.array([member.sensor_name]).take(pa.array(np.zeros(n_rows * n_samples, int))))
            position_parts.append(np.tile(np.arange(n_samples, dtype=np.int32), n_rows))
            value_parts.append(values.ravel())
            length_parts.append(np.full(n_rows * n_samples, n_channels))
            order.append(np.repeat(rows, n_samples))
            counts[rows] += n_samples
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    if not order:
        element = pa.struct([("sensor_name", pa.string()), ("position", pa.int32()), ("sensor_value", pa.list_(pa.float64()))])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array([], type=element))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(length_parts))]).astype(np.int32)
    samples = pa.StructArray.from_arrays(
        [
            pa.concat_arrays(sensor_parts),
            pa.array(np.concatenate(position_parts)),
            pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(value_parts))),
        ],
        names=["sensor_name", "position", "sensor_value"],
    )
    owner = np.concatenate(order)
    if (np.diff(owner) < 0).any():
        samples = samples.take(pa.array(np.argsort(owner, kind="stable")))
    return pa.ListArray.from_arrays(pa.array(offsets), samples)


def _decoder(chosen: Sequence[Layout]):
    groups: dict[tuple[str, str | None], list[Layout]] = {}
    for layout in chosen:
        groups.setdefault((layout.packet_type_name, layout.node_id), []).append(layout)
    overridden = {node for _, node in groups if node is not None}

    def decode(names: pa.Array, nodes: pa.Array, packets: pa.Array) -> pa.Array:
        packets = packets.cast(pa.binary())
        name_codes = names.dictionary_encode()
        node_codes = nodes.dictionary_encode()
        name_index = name_codes.indices.to_numpy(zero_copy_only=False)
        node_index = node_codes.indices.to_numpy(zero_copy_only=False)
        node_values = node_codes.dictionary.to_pylist()
        found = []
        for (name, node), members in groups.items():
            if name not in name_codes.dictionary.to_pylist():
                continue
            hit = name_index == name_codes.dictionary.to_pylist().index(name)
            if node is None:
                special = [i for i, value in enumerate(node_values) if value in overridden]
                hit &= ~np.isin(node_index, special)
            else:
                hit &= np.isin(node_index, [i for i, value in enumerate(node_values) if value == node])
            rows = np.flatnonzero(hit)
            if len(rows):
                found.append((rows, members))
        return _samples_of(len(names), packets, found)

    decode.__annotations__ = {"names": pa.Array, "nodes": pa.Array, "packets": pa.Array, "return": pa.Array}
    # declared non-deterministic so that no filter inferred from unfolding the samples decodes a second time
    return F.arrow_udf(decode, SAMPLE_TYPE).asNondeterministic()


#: The sensor whose counts shape each packet type.
SHAPED_BY = {
    "Abs. baros": "Baros_P",
    "Diff. baros": "Diff_Baros",
    "Mic 0": "Mics",
    "IMU Accel": "Acc",
    "IMU Gyro": "Acc",
    "IMU Magnetometer": "Acc",
    "Constat": "Constat",
    "Analog Vbat": "Analog Vbat",
}


@lru_cache(maxsize=4096)
def shaped_layouts(packet_type_name: str, channels: int, samples: int, endian: str) -> list[Layout]:
    """The layouts of one packet type for the counts and byte order that a node is configured with."""
    sensor = SHAPED_BY.get(packet_type_name)
    if sensor is None:
        return []
    every = layouts({sensor: channels}, {sensor: samples}, endian)
    return [layout for layout in every if layout.packet_type_name == packet_type_name]


def _configured(names: pa.Array, channels: pa.Array, samples: pa.Array, endians: pa.Array, packets: pa.Array) -> pa.Array:
    columns = [c.dictionary_encode() for c in (names, channels, samples, endians)]
    codes = np.stack([c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in columns], axis=1)
    shapes, which = np.unique(codes, axis=0, return_inverse=True)
    found = []
    for i, shape in enumerate(shapes):
        if (shape >= 0).all():
            members = shaped_layouts(*[c.dictionary[int(k)].as_py() for c, k in zip(columns, shape)])
            if members:
                found.append((np.flatnonzero(which.ravel() == i), members))
    return _samples_of(len(names), packets.cast(pa.binary()), found)


def decode_configured(packets: DataFrame, decodable: Column, instead: Column | None = None) -> DataFrame:
    """:func:`decode_packets` by the layout that each row itself names: ``channels``, ``samples`` and ``endian``."""
    pick = lambda c: F.when(decodable, F.col(c))
    # declared non-deterministic so that no filter inferred from unfolding the samples decodes a second time
    decoder = F.arrow_udf(_configured, SAMPLE_TYPE).asNondeterministic()
    decoded = decoder(*[pick(c) for c in ("packet_type_name", "channels", "samples", "endian", "packet")])
    if instead is not None:
        decoded = F.coalesce(instead, decoded)
    kept = [c for c in packets.columns if c not in ("packet", "channels", "samples", "endian")]
    return packets.select(*kept, decoded.alias("_samples")).select(*kept, F.inline("_samples"))


def _check_keys(chosen: Sequence[Layout]) -> None:
    nodes = {l.node_id for l in chosen}
    for node in nodes - {None}:
        names = {l.packet_type_name for l in chosen if l.node_id == node}
        missing = {l.packet_type_name for l in chosen if l.node_id is None} - names
        if missing:
            raise ValueError(f"node {node!r} overrides layouts but lacks {sorted(missing)}")


def min_bytes(chosen: Sequence[Layout]) -> dict[tuple[str, str | None], int]:
    """Shortest acceptable payload per packet name and overriding node (None: all others)."""
    needed: dict[tuple[str, str | None], int] = {}
    for layout in chosen:
        key = (layout.packet_type_name, layout.node_id)
        needed[key] = max(needed.get(key, 0), layout.min_bytes)
    return needed


def decode_packets(
    packets: DataFrame,
    chosen: Sequence[Layout] | None = None,
    decodable: Column | None = None,
    instead: Column | None = None,
) -> DataFrame:
    """One row per sample instant: all packet columns but the payload, plus sensor_name, position, sensor_value.

    Rows must carry ``packet_type_name`` and a payload of at least the layout's
    length; ``operators.routing.classify`` rejects the others.  With
    ``decodable`` only those rows go to the decoder, and the rest give the
    samples of ``instead`` (an array like SAMPLE_TYPE, or null).
    """
    chosen = list(chosen) if chosen is not None else layouts()
    _check_keys(chosen)
    name, payload = F.col("packet_type_name"), F.col("packet")
    if decodable is not None:
        name, payload = F.when(decodable, name), F.when(decodable, payload)
    decoded = _decoder(chosen)(name, F.col("packet_origin"), payload)
    if instead is not None:
        decoded = F.coalesce(instead, decoded)
    kept = [c for c in packets.columns if c != "packet"]
    return packets.select(*kept, decoded.alias("_samples")).select(*kept, F.inline("_samples"))


def _native_value(layout: Layout, channel: int, offset: int) -> Column:
    width, kind = layout.columns()[channel]
    payload = F.col("packet")
    if kind == "float":
        value = binary.float32(payload, offset, layout.endian)
    elif kind == "int":
        value = binary.signed_int(payload, offset, width, layout.endian)
    else:
        value = binary.unsigned_int(payload, offset, width, layout.endian)
    return value.cast("double") / F.lit(layout.divisor)


def decode_natively(packets: DataFrame, layout: Layout) -> DataFrame:
    """Same rows as :func:`decode_packets` for one layout, without a Python worker."""
    pad = [F.lit(0.0)] * (layout.number_of_channels - len(layout.offsets[0]))
    samples = F.array(
        *[
            F.array(*[_native_value(layout, c, offset) for c, offset in enumerate(row)], *pad)
            for row in layout.offsets
        ]
    )
    hit = F.col("packet_type_name") == layout.packet_type_name
    hit = hit if layout.node_id is None else hit & (F.col("packet_origin") == layout.node_id)
    kept = [c for c in packets.columns if c != "packet"]
    return (
        packets.where(hit)
        .select(*kept, F.posexplode(samples).alias("position", "sensor_value"))
        .withColumn("sensor_name", F.lit(layout.sensor_name))
        .select(*kept, "sensor_name", "position", "sensor_value")
    )


def battery_sample(endian: str | Column = "little") -> Column:
    """The one sample of a battery packet (after its code byte): voltage, cycle count, state of charge."""
    word = lambda offset: binary.unsigned_int(F.col("packet"), offset, 4, endian)
    return F.array(
        F.struct(
            F.lit("battery_info").alias("sensor_name"),
            F.lit(0).alias("position"),
            F.array(word(1) / 1e6, word(5) / 100.0, word(9) / 256.0).alias("sensor_value"),
        )
    )


def decode_battery(packets: DataFrame, endian: str | Column = "little") -> DataFrame:
    kept = [c for c in packets.columns if c != "packet"]
    return packets.select(*kept, F.inline(battery_sample(endian)))


#: Words of each kind of time synchronisation dump.
SYNC_WORDS = {0: 18, 1: 60, 2: 61, 3: 61, 4: 61}


def time_sync_faults(packets: DataFrame, endian: str | Column = "little") -> DataFrame:
    """Dumps that :func:`decode_time_sync` can't give whole, with ``reject_reason``."""
    kind = binary.unsigned_int(F.col("packet"), 1, 4, endian)
    words = F.floor((F.octet_length("packet") - 5) / 4)
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for pair in SYNC_WORDS.items() for x in pair]), kind.cast("int"))
    reason = (
        F.when(kind.isNull(), "short_payload")
        .when(~kind.isin(*SYNC_WORDS), "unknown_time_sync_kind")
        .when(words < wanted, "short_payload")
    )
    return packets.withColumn("reject_reason", reason).where(F.col("reject_reason").isNotNull())


def decode_time_sync(
    packets: DataFrame, endian: str | Column = "little", central_limit: int | None = None, keys: Sequence[str] = ("packet_origin",)
) -> DataFrame:
    """Time synchronisation dumps: (kind, position, value) rows; a cut-off dump gives the words that it has.
    Other kinds and cut-off dumps are told by :func:`time_sync_faults`.

    ``central_limit`` ends the central dump (kind 1) after so many words in all
    per key, counted over packets in ``seq`` order before their words are unfolded.
    """
    kind = binary.unsigned_int(F.col("packet"), 1, 4, endian)
    count = F.when(F.col("kind") == 0, 18).when(F.col("kind") == 1, 60).when(F.col("kind").isin(2, 3, 4), 61).otherwise(0)
    kept = [c for c in packets.columns if c != "packet"]
    dumps = packets.withColumn("kind", kind).where(F.col("kind").between(0, 4))
    words = dumps.select(*kept, "kind", binary.word_array(F.col("packet"), 5, count, endian).alias("words"))
    if central_limit is not None:
        words = _cut_central(words, central_limit, keys)
    # the sequence dump ends in three signed words
    signed = F.when(
        (F.col("kind") == 0) & (F.col("position") >= 15) & (F.col("word") >= 1 << 31), F.col("word") - (1 << 32)
    ).otherwise(F.col("word"))
    return (
        words.select(*kept, "kind", F.posexplode("words").alias("position", "word"))
        .withColumn("value", signed)
        .drop("word")
    )


def _cut_central(words: DataFrame, limit: int, keys: Sequence[str]) -> DataFrame:
    size = F.size("words").cast("bigint")
    central = running_totals(words.where("kind = 1"), keys, "seq", {"_so_far": size})
    left = F.lit(limit) - (F.col("_so_far") - size)
    cut = central.where(left > 0).withColumn("words", F.slice("words", F.lit(1), F.least(left, size).cast("int")))
    return words.where("kind <> 1").unionByName(cut.drop("_so_far"))


def decode_ticks(packets: DataFrame, endian: str | Column = "little") -> DataFrame:
    """Timestamp packets: each whole 32-bit word of the payload is one tick row."""
    count = F.floor(F.octet_length("packet") / 4)
    words = binary.word_array(F.col("packet"), 0, count, endian)
    kept = [c for c in packets.columns if c != "packet"]
    return packets.select(*kept, F.posexplode(words).alias("position", "tick"))


def sample_times(samples: DataFrame, timestamp: str, period: str, anchor: str = "start") -> DataFrame:
    """Adds ``sample_time``: forward from the packet time, or backward with it as the end of the packet.

    ``anchor="end"`` needs the column ``samples_in_packet``.
    """
    if anchor == "start":
        time = F.col(timestamp) + F.col("position") * F.col(period)
    else:
        time = F.col(timestamp) - (F.col("samples_in_packet") - F.col("position")) * F.col(period)
    return samples.withColumn("sample_time", time)


def calibrate(samples: DataFrame, constants: str = "conversion_constants") -> DataFrame:
    """Channel values divided by their conversion constants (opt-in: raw values are the default everywhere)."""
    return samples.withColumn(
        "sensor_value", F.zip_with(F.col("sensor_value"), F.col(constants), lambda v, c: v / c)
    )
