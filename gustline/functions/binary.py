"""Numbers out of binary columns, as native Spark expressions.

Offsets are zero-based bytes.  These serve control fields (node clock, handle
bytes, battery words); whole sample blocks go through ``operators.decode``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hex_digits(payload: Column, offset: int, width: int, endian: str | Column) -> Column:
    if isinstance(endian, Column):
        big, little = (_hex_digits(payload, offset, width, order) for order in ("big", "little"))
        return big if width == 1 else F.when(endian == "big", big).otherwise(little)
    positions = range(offset, offset + width)
    if endian == "little":
        # byte order is swapped by picking bytes one by one: reverse() on binary works on UTF-8 characters
        return F.concat(*[F.hex(F.substring(payload, p + 1, 1)) for p in reversed(positions)])
    return F.hex(F.substring(payload, offset + 1, width))


def unsigned_int(payload: Column, offset: int, width: int, endian: str | Column = "little") -> Column:
    """Unsigned integer of ``width`` bytes; null when the payload is too short.  ``endian`` may differ from row to row."""
    value = F.conv(_hex_digits(payload, offset, width, endian), 16, 10).cast("bigint")
    return F.when(F.octet_length(payload) >= offset + width, value)


def signed_int(payload: Column, offset: int, width: int, endian: str = "little") -> Column:
    """Two's complement integer of ``width`` bytes; null when the payload is too short."""
    raw = unsigned_int(payload, offset, width, endian)
    return F.when(raw >= F.lit(1 << (8 * width - 1)), raw - F.lit(1 << (8 * width))).otherwise(raw)


def float32(payload: Column, offset: int, endian: str = "little") -> Column:
    """IEEE single precision value widened to double, including subnormals, infinities and NaN."""
    bits = unsigned_int(payload, offset, 4, endian)
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
    fraction = bits.bitwiseAND(F.lit(8388607)) / F.lit(8388608.0)
    sign = F.when(bits >= F.lit(1 << 31), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when((exponent == 255) & (fraction > 0), F.lit(float("nan")))
        .when(exponent == 255, sign * F.lit(float("inf")))
        .when(exponent == 0, sign * fraction * F.pow(F.lit(2.0), F.lit(-126)))
        .otherwise(sign * (1 + fraction) * F.pow(F.lit(2.0), exponent - 127))
    )


def whole_unsigned(payload: Column, endian: str | Column = "little") -> Column:
    """The whole payload, of any length, as one unsigned integer; null when empty or beyond 56 bits."""
    if isinstance(endian, Column):
        return F.when(endian == "big", whole_unsigned(payload, "big")).otherwise(whole_unsigned(payload, "little"))
    size = F.octet_length(payload)
    kept = F.least(size, F.lit(7))
    if endian == "little":
        low, high = F.substr(payload, F.lit(1), kept), F.substr(payload, F.lit(8), size)
    else:
        low, high = F.substr(payload, size - kept + 1, kept), F.substr(payload, F.lit(1), size - kept)
    branches = F.when(F.hex(high).rlike("[^0]"), F.lit(None).cast("bigint"))
    for width in range(1, 8):
        branches = branches.when(kept == width, unsigned_int(low, 0, width, endian))
    return branches


def _words(payloads: pa.Array, offsets: pa.Array, counts: pa.Array, big_endian: pa.Array) -> pa.Array:
    payloads = payloads.cast(pa.binary())
    starts = np.frombuffer(payloads.buffers()[1], np.int32)[payloads.offset : payloads.offset + len(payloads) + 1]
    data = np.frombuffer(payloads.buffers()[2] or b"", np.uint8)
    wanted = counts.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    from_byte = offsets.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    fitting = np.maximum((np.diff(starts) - from_byte) // 4, 0)
    wanted = np.minimum(wanted, fitting)
    bounds = np.concatenate([[0], np.cumsum(wanted)])
    within = np.arange(bounds[-1]) - np.repeat(bounds[:-1], wanted)
    at = np.repeat(starts[:-1] + from_byte, wanted) + 4 * within
    quads = np.ascontiguousarray(data[at[:, None] + np.arange(4)])
    big = np.repeat(big_endian.fill_null(False).to_numpy(zero_copy_only=False), wanted)
    values = np.where(big, quads.view(">u4").ravel(), quads.view("<u4").ravel()).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def word_array(payload: Column, offset: int, count: Column, endian: str | Column = "little") -> Column:
    """Up to ``count`` consecutive unsigned 32-bit words from ``offset`` on, as many as the payload holds whole.

    Long word dumps are unpacked a batch at a time with numpy.
    """
    # declared non-deterministic so that no filter inferred from unfolding the words unpacks a second time
    unpack = F.arrow_udf(_words, T.ArrayType(T.LongType())).asNondeterministic()
    return unpack(payload, F.lit(offset), count.cast("int"), F.lit(endian == "big"))


def little_endian_bytes(value: Column, width: int) -> Column:
    """Inverse of :func:`unsigned_int`: the low ``width`` bytes of a non-negative bigint."""
    digits = F.lpad(F.hex(value), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))]))
