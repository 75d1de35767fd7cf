"""Word and shingle hashes of whole texts, one numpy pass over the bytes of an Arrow batch.

Texts never become Python strings here: words are runs of bytes, hashed from
prefix sums of a polynomial, so the cost per byte is the same for one long text
and for many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a single longer text is handled alone.
CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def byte_class(pattern_excludes: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes that belong to words: all but the given inclusive ranges."""
    table = np.ones(256, bool)
    for low, high in pattern_excludes:
        table[low : high + 1] = False
    return table


#: Words between blanks, tabs and line ends.
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Runs of digits, letters and everything beyond ASCII.
ALPHANUMERIC = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: np.uint64, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, 3 * CHUNK_BYTES // 2), _powers(_BASE_INVERSE, 3 * CHUNK_BYTES // 2)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; only those for texts of usual length are kept."""
    if n <= 3 * CHUNK_BYTES // 2:
        return _usual_powers()
    return _powers(_BASE, n), _powers(_BASE_INVERSE, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: hash and document (position in the batch) of each, in order."""

    hashes: np.ndarray
    document: np.ndarray
    counts: np.ndarray
    """Number of words of each document."""

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold about ``limit`` bytes each, one document at least."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


def words_of(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray, lower: bool = True) -> Words:
    """Words of documents data[offsets[i]:offsets[i + 1]]; ASCII capitals count as small letters if ``lower``."""
    n = len(offsets) - 1
    if lower:
        data = _LOWER[data]
    inside = in_word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets[1:]] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    values = data.astype(np.uint64)
    values += np.uint64(1)
    values *= up[: len(data)]
    np.cumsum(values, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * _STEP)
    document = np.searchsorted(offsets, starts, "right") - 1
    return Words(hashes, document, np.bincount(document, minlength=n).astype(np.int64))


def grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, and whether they lie in one document."""
    n = len(words.hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    last = n - size + 1
    value = np.full(last, np.uint64(size), np.uint64)
    for k in range(size):
        value = value * _STEP + words.hashes[k : k + last]
    return mix(value), words.document[:last] == words.document[size - 1 :]


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted, and the n + 1 offsets of the documents.

    A document of fewer words than ``size`` has one shingle, its whole sequence; one without words has none.
    """
    n = len(words.counts)
    value, whole = grams(words, size)
    document = words.document[: len(value)][whole]
    value = value[whole]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        lone = np.zeros(len(short), np.uint64)
        first = words.first
        for k in range(size - 1):
            has = words.counts[short] > k
            at = first[short[has]] + k
            lone[has] = lone[has] * _STEP + words.hashes[at]
        lone = mix(lone + words.counts[short].astype(np.uint64))
        value = np.concatenate([value, lone])
        document = np.concatenate([document, short])
    if len(short):
        order = np.argsort(document, kind="stable")
        value, document = value[order], document[order]
    ends = np.cumsum(np.bincount(document, minlength=n)).tolist()
    for start, end in zip([0, *ends], ends):
        value[start:end].sort()
    if len(value):
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (document[1:] != document[:-1])
        value, document = value[fresh], document[fresh]
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(document, minlength=n), out=offsets[1:])
    return value, offsets


def set_digests(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each document's set; equal for equal sets, 0 for the empty set."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.zeros(n, np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        # sums of two mixed values: independent of order, and of whatever else is in the batch
        one = np.add.reduceat(mix(value ^ _BASE), offsets[full])
        two = np.add.reduceat(mix(value * _STEP), offsets[full])
        out[full] = mix(one ^ mix(two + sizes[full].astype(np.uint64)))
    return out


def longs(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's signed longs."""
    return pa.array(values.view(np.int64))
