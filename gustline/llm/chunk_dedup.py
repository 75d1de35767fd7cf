"""Exact duplicates by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes says so; its recipe
is the ordered list of chunk fingerprints.  Chunks are deduplicated once, by
fingerprint and bytes, which verifies that a fingerprint names one byte string.
From then on only recipes move: texts are equal when their lists are.  Where a
fingerprint turns out to name two byte strings, the texts that hold it are told
apart by their SHA-256 as well, so a collision can't join different texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.rows import keep_rows, text_sha
from gustline.llm.staging import Staging
from gustline.llm.words import mix, parts, text_bytes

#: Chunks have at least and at most so many bytes, and about 4096 in between.
LEAST, MOST, MEAN_BITS = 1024, 1 << 16, 12
WINDOW = 32
FINGERPRINT = 16

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _marks(data: np.ndarray) -> np.ndarray:
    """Positions after which the hash of the last 32 bytes asks for a cut."""
    value = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = value[:-step] << np.uint32(step)
        value[step:] += shifted
    return np.flatnonzero(value >> np.uint32(32 - MEAN_BITS) == 0) + 1


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
    """For each document, the ends of its chunks (positions in ``data``)."""
    marks = _marks(data) if len(data) > LEAST else np.zeros(0, np.int64)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ends, at = [], start
        while end - at > LEAST:
            k = np.searchsorted(marks, at + LEAST)
            at = min(int(marks[k]) if k < len(marks) else end, at + MOST, end)
            ends.append(at)
        if at < end:
            ends.append(end)
        yield ends


def _fingerprint(piece: memoryview, keep: int) -> bytes:
    digest = xxhash.xxh3_128_digest(piece)
    return digest if keep == FINGERPRINT else digest[:keep].rjust(FINGERPRINT, b"\0")


def _chunked(batch: pa.RecordBatch) -> Iterator[tuple[int, memoryview, list[memoryview]]]:
    data, offsets = text_bytes(batch.column("text"))
    for a, b in parts(offsets):
        own = offsets[a : b + 1] - offsets[a]
        piece = data[offsets[a] : offsets[b]]
        view = memoryview(piece)
        for i, ends in enumerate(chunk_bounds(piece, own)):
            starts = [int(own[i]), *ends[:-1]]
            yield a + i, view[own[i] : own[i + 1]], [view[s:e] for s, e in zip(starts, ends)]


def recipes(docs: DataFrame, fingerprint_bytes: int = FINGERPRINT) -> DataFrame:
    """doc_id, text_sha256 and recipe (fingerprints in order, end to end) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, lists = [], []
            for _, whole, chunks in _chunked(batch):
                digests.append(hashlib.sha256(whole).hexdigest())
                lists.append(b"".join(_fingerprint(c, fingerprint_bytes) for c in chunks))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests, pa.string()), pa.array(lists, pa.binary())],
                ["doc_id", "text_sha256", "recipe"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, text_sha256 string, recipe binary"
    )


def chunks(docs: DataFrame, fingerprint_bytes: int = FINGERPRINT) -> DataFrame:
    """fingerprint and bytes of every chunk, each once per Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, bytes] = {}
            prints, pieces = [], []
            for _, _, found in _chunked(batch):
                for c in found:
                    key = _fingerprint(c, fingerprint_bytes)
                    content = bytes(c)
                    if known.setdefault(key, content) is content or known[key] != content:
                        prints.append(key)
                        pieces.append(content)
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints, pa.binary()), pa.array(pieces, pa.binary())], ["fingerprint", "content"]
            )

    return docs.select("text").mapInArrow(run, "fingerprint binary, content binary")


def find_copies(docs: DataFrame, staging: Staging | None = None, fingerprint_bytes: int = FINGERPRINT) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Reads ``doc_id`` and ``text`` only; other columns may have any name.  Texts are equal when identical byte for
    byte; null counts as empty, and all empty texts are equal.  Of a group the row with the largest doc_id stays; null
    doc_ids are smaller than any other, and where a group has nothing else keep_id is null.  Rows that repeat a doc_id
    with the same text are all counted and share its ``kept``.  An empty table gives none.

    No group is ever gathered: groups are counts and maxima, combined before the shuffle, and joined back by recipe.
    They are written first: a join of two plain shuffles is one that Spark splits where a recipe holds a large share.
    """
    staging = staging or Staging(docs.sparkSession)
    rows = staging.table(recipes(docs, fingerprint_bytes), "recipes")
    doubtful = (
        chunks(docs, fingerprint_bytes)
        .distinct()
        .groupBy("fingerprint")
        .count()
        .filter("count > 1")
        .select("fingerprint")
    )
    size = F.length("recipe") / FINGERPRINT
    prints = F.when(size > 0, F.transform(F.sequence(F.lit(1), size.cast("int")), lambda k: _slice(k)))
    unsure = (
        rows.select("recipe")
        .distinct()
        .select("recipe", F.explode(prints).alias("fingerprint"))
        .join(doubtful, "fingerprint", "left_semi")
        .select("recipe")
        .distinct()
        .withColumn("unsure", F.lit(True))
    )
    keyed = rows.join(unsure, "recipe", "left").withColumn(
        "tie", F.when(F.col("unsure"), F.col("text_sha256")).otherwise("")
    )
    keyed = staging.table(keyed.select("doc_id", "text_sha256", "recipe", "tie"), "keyed")
    groups = keyed.groupBy("recipe", "tie").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = staging.table(groups, "groups")
    return keyed.join(groups, ["recipe", "tie"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _slice(k):
    return F.substring("recipe", (k - 1) * FINGERPRINT + 1, FINGERPRINT)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, each (doc_id, text) once."""
    return keep_rows(docs, find_copies(docs).filter("kept").select("doc_id", "text_sha256"), text_sha())
