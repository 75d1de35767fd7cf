"""Rows of a table chosen by doc_id and a digest of the text, with all their columns."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spark's seed of xxhash64; with it, tasks in Python and expressions give the same keys.
SEED = 42


def text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The key of each text, as text_key() has it."""
    view = memoryview(data)
    ends = offsets.tolist()
    return np.array([xxhash.xxh64_intdigest(view[s:e], SEED) for s, e in zip(ends[:-1], ends[1:])], np.uint64)


def text_key() -> Column:
    """A 64-bit hash of ``text``; null counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def text_sha() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def shield(df: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with all but the used columns under names of our own, and the columns that bring theirs back."""
    own = {c: c if c in used else f"_own{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]), [F.col(n).alias(c) for c, n in own.items()]


def _joined(docs: DataFrame, chosen: DataFrame, digest: Column, how: str) -> DataFrame:
    chosen = chosen.toDF("_chosen_id", "_chosen_digest").distinct()
    marked = docs.withColumn("_digest", digest)
    same = F.col("doc_id").eqNullSafe(F.col("_chosen_id")) & (F.col("_digest") == F.col("_chosen_digest"))
    return marked.join(chosen, same, how)


def keep_rows(docs: DataFrame, chosen: DataFrame, digest: Column) -> DataFrame:
    """Rows of ``docs`` whose doc_id (nulls alike) and digest are in ``chosen``; one of each."""
    docs, back = shield(docs, "doc_id", "text")
    same = Window.partitionBy("doc_id", "_digest").orderBy("_digest")
    held = _joined(docs, chosen, digest, "left_semi").withColumn("_nth", F.row_number().over(same))
    return held.filter("_nth = 1").select(*back)


def drop_rows(docs: DataFrame, chosen: DataFrame, digest: Column) -> DataFrame:
    """Rows of ``docs`` whose doc_id and digest are not in ``chosen``."""
    docs, back = shield(docs, "doc_id", "text")
    return _joined(docs, chosen, digest, "left_anti").select(*back)
