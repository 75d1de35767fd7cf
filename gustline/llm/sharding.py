"""Shards of near equal bytes by sampled splitters, in DataFrame operations alone.

Records are ordered by (digest of the text, digest of the id, salt): equal texts
lie side by side, and even a group of equal records can be cut anywhere.  A
sample in which a record's chance is in proportion to its size gives quantiles
that bound some thousand ranges of like size; their true sizes are then summed,
and ranges that came out too full are sampled again and cut.  Shards are runs of
ranges, so the bounds of the ranges are all that it takes to place a record.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.rows import shield
from gustline.llm.staging import Staging

#: Ranges that one shard is made of, and samples drawn for each.
RANGES, SAMPLES = 256, 4
#: Most ranges in all before overfull ones are cut; bounds what is sampled, collected and sent.
MOST_RANGES = 1 << 14
#: A range is overfull beyond so many times its fair share, its largest record aside.
FULL = 2.0

KEY = "struct<h:long,d:long,s:long>"


def size_of() -> Column:
    """Bytes of ``text`` in UTF-8, none for null, plus one."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def key_of() -> Column:
    """Where a record stands: by its text, its id, and a salt that differs between equal records."""
    salt = F.xxhash64(F.monotonically_increasing_id())
    text, name = F.xxhash64(F.coalesce("text", F.lit(""))), F.xxhash64("doc_id")
    return F.struct(text.alias("h"), name.alias("d"), salt.alias("s"))


def _literal(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _range(key: Column, splitters: list[tuple]) -> Column:
    """The number of splitters that are not above ``key``, by binary search."""
    if not splitters:
        return F.lit(0)
    table = _literal([dict(zip("hds", s)) for s in splitters], KEY)
    steps = F.sequence(F.lit(1), F.lit(len(splitters).bit_length()))

    def step(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        above = (state["low"] == state["high"]) | (F.get(table, middle) > key)
        low = F.when(above, state["low"]).otherwise(middle + 1)
        high = F.when(above & (state["low"] < state["high"]), middle).otherwise(state["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(splitters)).alias("high"))
    return F.aggregate(steps, start, step, lambda s: s["low"])


@dataclass(frozen=True)
class Plan:
    """Splitters of the ranges, and for each range its shard and the records of that shard before it."""

    splitters: list[tuple]
    shard: list[int]
    before: list[int]

    def range(self, key: Column) -> Column:
        return _range(key, self.splitters)

    def shard_of(self, place: Column) -> Column:
        return F.get(_literal(self.shard, "int"), place)

    def before_of(self, place: Column) -> Column:
        return F.get(_literal(self.before, "long"), place)


def _sample(records: DataFrame, splitters: list[tuple], chance: Column, places: list[int] | None = None) -> dict[int, list]:
    """Keys drawn with the given chance, in order, by the range they lie in."""
    drawn = records.filter(F.shiftrightunsigned(F.xxhash64("key", F.lit(11)), 11) < chance * float(1 << 53))
    drawn = drawn.withColumn("range", _range(F.col("key"), splitters))
    if places is not None:
        drawn = drawn.filter(F.array_contains(_literal(places, "int"), F.col("range")))
    out: dict[int, list] = {}
    for row in drawn.select("range", "key").orderBy("key").collect():
        out.setdefault(row.range, []).append(tuple(row.key))
    return out


def _counted(records: DataFrame, splitters: list[tuple]) -> list[tuple[int, int, int]]:
    """Bytes, records and the largest record of each range; one row a range reaches the driver."""
    totals = records.groupBy(_range(F.col("key"), splitters).alias("range")).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("most")
    )
    found = {r.range: (r.bytes, r.n, r.most) for r in totals.collect()}
    return [found.get(i, (0, 0, 0)) for i in range(len(splitters) + 1)]


def plan_shards(records: DataFrame, shards: int) -> Plan:
    """A plan for ``records`` (key, size), a written table, since every pass must see the same keys.

    The driver holds keys of SAMPLES and one total for each of RANGES * shards ranges, MOST_RANGES at most before
    overfull ones are cut.  Cutting goes on until no range holds more than FULL times its share beside its largest
    record, whatever the keys.
    """
    total = records.agg(F.sum("size")).first()[0] or 0
    ranges = max(shards, min(MOST_RANGES, RANGES * shards))
    share = max(1.0, total / ranges)
    drawn = [k for keys in _sample(records, [], F.col("size") * SAMPLES / share).values() for k in keys]
    splitters = sorted(set(drawn[SAMPLES::SAMPLES]))
    totals = _counted(records, splitters)
    while True:
        full = [i for i, (size, n, most) in enumerate(totals) if n > 1 and size - most > FULL * share]
        if not full:
            break
        again = _sample(records, splitters, F.col("size") * 4 * SAMPLES / share, full)
        fresh = set(splitters).union(*(keys[:: 4 * SAMPLES][1:] or keys[-1:] for keys in again.values()))
        if len(fresh) == len(splitters):
            break
        splitters = sorted(fresh)
        totals = _counted(records, splitters)
    shard, before, counts = [], [], [0] * shards
    for end, (size, n, _) in zip(accumulate(t[0] for t in totals), totals):
        place = min(shards - 1, int((end - size / 2) * shards / total)) if total else 0
        shard.append(place)
        before.append(counts[place])
        counts[place] += n
    return Plan(splitters, shard, before)


def _records(docs: DataFrame, *extra: Column) -> DataFrame:
    return docs.select(key_of().alias("key"), size_of().alias("size"), *extra)


def assign(docs: DataFrame, shards: int = 16, staging: Staging | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row of ``docs``.

    Reads ``doc_id`` and ``text`` alone.  A null text counts as empty: size 1, checksum 0.  Null ids and repeated rows
    are records like others; a group of equal ones is cut where a shard is full.  Shards differ by about one range
    and the records at their edges; a record larger than a shard's share makes its shard larger.  An empty table gives
    no rows.  Texts are read once; what moves afterwards are some 40 bytes a record.
    """
    checksum = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    staging = staging or Staging(docs.sparkSession)
    records = staging.table(_records(docs, F.col("doc_id"), checksum), "records")
    plan = plan_shards(records, shards)
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("key"))
    placed = records.withColumn("_range", plan.range(F.col("key"))).withColumn("_nth", nth)
    slot = plan.before_of(F.col("_range")) + F.col("_nth") - 1
    return placed.select("doc_id", "size", "text_crc32", plan.shard_of(F.col("_range")).alias("shard"), slot.alias("slot"))


def place(docs: DataFrame, plan: Plan) -> DataFrame:
    """``docs`` with all their columns, and ``shard``; a column of that name is replaced."""
    own, restore = shield(docs.drop("shard"), "doc_id", "text")
    return own.withColumn("_shard", plan.shard_of(plan.range(key_of()))).select(*restore, F.col("_shard").alias("shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, files: int = 1) -> None:
    """Writes ``docs`` to one folder for each shard, about ``files`` files in each, equal texts side by side."""
    staging = Staging(docs.sparkSession)
    plan = plan_shards(staging.table(_records(docs), "records"), shards)
    staging.drop()
    own, restore = shield(docs.drop("shard"), "doc_id", "text")
    wide = max(1, len(plan.shard) // (shards * files))
    keyed = own.withColumn("_key", key_of()).withColumn("_range", plan.range(F.col("_key")))
    keyed = keyed.withColumn("_shard", plan.shard_of(F.col("_range")))
    dealt = keyed.repartition(shards * files, "_shard", F.floor(F.col("_range") / wide)).sortWithinPartitions("_shard", "_key")
    dealt.select(*restore, F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)
