"""Best-fit packing of documents into bins under conflicts.

Bins are ordered by what is left in them and carry bit fields of the sources
and duplicate clusters they hold.  A piece goes to the tightest bin that has
room and shares neither with it: the search starts at the smallest residual
that fits and goes on to the next until a bin is compatible, else a bin opens.
Packing is in order, so documents are dealt by hash into shards of bounded
size, each with bins of its own; the number of shards follows the input, and a
source or cluster of any size is spread over all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Room of a bin in units of length (code points), and pieces of a shard on average.
CAPACITY, SHARD_PIECES = 8192, 2000


class Bins:
    """Open bins by residual; each residual knows what all of its bins conflict with, so that most are passed at once."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals: list[int] = []
        self.held: list[tuple[int, int]] = []
        self.at: dict[int, list[int]] = {}
        self.common: dict[int, tuple[int, int]] = {}
        self.filled = 0
        """Bit r is set if a bin with residual r is open."""

    def _place(self, number: int) -> None:
        left = self.residuals[number]
        if left == 0:
            return
        group = self.at.setdefault(left, [])
        sources, clusters = self.held[number]
        if group:
            s, c = self.common[left]
            sources, clusters = s & sources, c & clusters
        self.common[left] = (sources, clusters)
        group.append(number)
        self.filled |= 1 << left

    def _take(self, left: int, number: int) -> None:
        group = self.at[left]
        group.remove(number)
        if not group:
            del self.at[left], self.common[left]
            self.filled &= ~(1 << left)
            return
        sources, clusters = self.held[group[0]]
        for other in group[1:]:
            s, c = self.held[other]
            sources, clusters = sources & s, clusters & c
        self.common[left] = (sources, clusters)

    def add(self, length: int, source: int, cluster: int) -> int:
        """The bin that takes a piece; source and cluster are bit fields."""
        rest = self.filled >> length
        left = length - 1
        while rest:
            step = (rest & -rest).bit_length()
            left, rest = left + step, rest >> step
            s, c = self.common[left]
            if s & source or c & cluster:
                continue
            for number in self.at[left]:
                s, c = self.held[number]
                if not (s & source or c & cluster):
                    self._take(left, number)
                    self.residuals[number] = left - length
                    self.held[number] = (s | source, c | cluster)
                    self._place(number)
                    return number
        self.residuals.append(self.capacity - length)
        self.held.append((source, cluster))
        self._place(len(self.held) - 1)
        return len(self.held) - 1


def _bits(keys: list) -> list[int]:
    """A bit for each distinct key that occurs more than once; no bit for a missing one or one that can't conflict."""
    counts: dict = {}
    for k in keys:
        counts[k] = counts.get(k, 0) + 1
    number: dict = {}
    return [0 if k is None or counts[k] < 2 else 1 << number.setdefault(k, len(number)) for k in keys]


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pieces and bins of one shard: full pieces in bins of their own, then the rests, the longest first.

    Ties go by doc_id and cluster.  A rest of no length is a piece only of a document of no length; it has bin -1.
    """
    rows = rows.assign(full=rows["length"] // capacity, rest=rows["length"] % capacity)
    rows = rows.sort_values(["rest", "doc_id", "cluster"], ascending=[False, True, True])
    missing = lambda c: [None if pd.isna(x) else x for x in rows[c]]
    bins = Bins(capacity)
    rests = rows["rest"].tolist()
    numbers = [bins.add(n, s, c) if n else -1 for n, s, c in zip(rests, _bits(missing("source")), _bits(missing("cluster")))]
    left = np.array([*bins.residuals, 0], np.int64)
    tail = rows.assign(piece=rows["full"], length=rows["rest"], bin=np.array(numbers, np.int64))
    tail = tail[(tail["rest"] > 0) | (tail["full"] == 0)]
    tail = tail.assign(residual=left[tail["bin"]], slot=tail.groupby("bin").cumcount())
    whole = rows.loc[rows.index.repeat(rows["full"])]
    nth = whole.groupby(level=0).cumcount()
    whole = whole.assign(piece=nth, length=capacity, bin=np.arange(len(whole)) + len(bins.residuals), residual=0, slot=0)
    return pd.concat([tail, whole])[["shard", "doc_id", "piece", "length", "bin", "residual", "slot"]]


def with_clusters(docs: DataFrame) -> DataFrame:
    """doc_id, source, length and cluster: equal texts are a cluster.  Null texts are empty and in none."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.length(text).alias("length"),
        F.when(F.length(text) > 0, F.xxhash64(text)).alias("cluster"),
    )


def pack(lengths: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Bins for rows of ``doc_id``, ``source``, ``length`` and ``cluster``; other columns are not read.

    A document longer than ``capacity`` is cut: full pieces fill bins alone, the rest is packed.  No bin holds two
    pieces of one source or of one cluster; a null source or cluster conflicts with nothing.  One row per piece comes
    back: doc_id, piece, start, length, bin_id, slot (place in the bin) and residual (what the bin has left).  A document
    of no length is one piece without a bin: bin_id is null.  Repeated rows are packed each, null doc_ids too.  An empty
    table gives no rows.
    """
    rows = lengths.select("doc_id", "source", F.coalesce("length", F.lit(0)).cast("int").alias("length"), "cluster")
    count = rows.count()
    shards = max(1, -(-count // shard_pieces))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "length"), F.lit(shards)).cast("int"))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(group, capacity)

    packed = dealt.groupBy("shard").applyInPandas(
        run, "shard int, doc_id long, piece long, length int, bin long, residual int, slot int"
    )
    return packed.select(
        "doc_id",
        "piece",
        (F.col("piece") * capacity).alias("start"),
        "length",
        F.when(F.col("bin") >= 0, F.concat_ws("-", "shard", "bin")).alias("bin_id"),
        "slot",
        "residual",
    )
