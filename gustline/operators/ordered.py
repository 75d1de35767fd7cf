"""Ordered operators (as-of join, running totals, lag, rolling frames) that stay parallel on hot keys.

A plain window over ``partitionBy(key).orderBy(seq)`` puts a whole key into one
task.  Here every key is cut into blocks of the order column, a bigint that is
unique within the key, so a block never holds more than ``block_rows`` rows.
What a block needs from earlier blocks comes from a summary with one row per
(key, block): the summary is pre-aggregated on the map side, carried forward by
a window over summary rows only, and handed to each block as one carry row.
Rows themselves are shuffled once, by (key, block).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 18

_BLOCK = "_block"
_SIDE = "_side"


def block_of(order: str | Column, block_rows: int = BLOCK_ROWS) -> Column:
    column = F.col(order) if isinstance(order, str) else order
    return F.floor(column / F.lit(block_rows)).cast("bigint")


def _within(keys: Sequence[str], *order) -> Window:
    return Window.partitionBy(*keys, _BLOCK).orderBy(*order)


def _before(keys: Sequence[str]) -> Window:
    """All summary rows of the key that precede the current block."""
    return Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Left rows with ``values`` of the latest right row whose order is not after theirs (nulls if none)."""
    packed = F.struct(*[F.col(v) for v in values])
    facts = right.select(*keys, order, packed.alias("_right")).withColumn(_BLOCK, block_of(order, block_rows))
    rows = left.withColumn(_BLOCK, block_of(order, block_rows))

    # left rows only name their block, right rows also bring their values; one map-side combined aggregate takes both.
    # one max_by per column, not one of a struct: fixed-width buffers keep this a hash aggregate
    own = [v for v in values if v not in keys and v != order]
    given = right.withColumn(_BLOCK, block_of(order, block_rows)).select(*keys, _BLOCK, order, *own)
    carried = (
        _stack([rows.select(*keys, _BLOCK), given])
        .groupBy(*keys, _BLOCK)
        .agg(F.max(order).alias("_at"), *[F.max_by(v, order).alias(v) for v in own])
        .withColumn(order, F.col("_at"))
        .select(*keys, _BLOCK, F.when(F.col("_at").isNotNull(), F.struct("_at", packed.alias("_right"))).alias("_tail"))
        .withColumn("_carry", F.last("_tail", ignorenulls=True).over(_before(keys)))
        .where(F.col("_carry").isNotNull())
        .select(*keys, _BLOCK, F.col("_carry._at").alias(order), F.col("_carry._right").alias("_right"))
    )
    everything = _stack(
        [rows.withColumn(_SIDE, F.lit(1)), facts.withColumn(_SIDE, F.lit(0)), carried.withColumn(_SIDE, F.lit(0))]
    )
    latest = F.last("_right", ignorenulls=True).over(_within(keys, order, _SIDE))
    return (
        everything.withColumn("_latest", latest)
        .where(F.col(_SIDE) == 1)
        .select(*left.columns, *[F.col("_latest").getField(v).alias(v) for v in values])
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    totals: dict[str, Column],
    block_rows: int = BLOCK_ROWS,
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sum of each expression along the order of its key."""
    position = -F.col(order) if descending else F.col(order)
    amounts = {name: f"_amount_{i}" for i, name in enumerate(totals)}
    rows = df.select(
        "*", *[totals[name].alias(col) for name, col in amounts.items()], position.alias("_position")
    ).withColumn(_BLOCK, block_of("_position", block_rows))
    carried = (
        rows.groupBy(*keys, _BLOCK)
        .agg(*[F.sum(col).alias(col) for col in amounts.values()])
        .select(*keys, _BLOCK, *[F.sum(col).over(_before(keys)).alias(col) for col in amounts.values()])
        .where(F.coalesce(*amounts.values()).isNotNull())
        .withColumn(_SIDE, F.lit(0))
    )
    frame = _within(keys, F.col("_position").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _stack([rows.withColumn(_SIDE, F.lit(1)), carried])
        .select("*", *[F.sum(col).over(frame).alias(name) for name, col in amounts.items()])
        .where(F.col(_SIDE) == 1)
        .select(*df.columns, *amounts)
    )


def ordinals(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "ordinal", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Row number from 1 within the key."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, block_rows)


def previous_row(
    df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds, under new names, columns of the row just before in the key; ``columns`` maps source to new name."""
    rows = df.withColumn(_BLOCK, block_of(order, block_rows))
    picked = [c for c in columns if c != order]
    tail = F.struct(F.col("_at").alias(order), *picked)
    carried = (
        rows.groupBy(*keys, _BLOCK)
        .agg(F.max(order).alias("_at"), *[F.max_by(c, order).alias(c) for c in picked])
        .select(*keys, _BLOCK, F.lag(tail).over(Window.partitionBy(*keys).orderBy(_BLOCK)).alias("_tail"))
        .where(F.col("_tail").isNotNull())
        .select(*keys, _BLOCK, "_tail.*")
        .withColumn(_SIDE, F.lit(0))
    )
    frame = _within(keys, order)
    return (
        _stack([rows.withColumn(_SIDE, F.lit(1)), carried])
        .select("*", *[F.lag(source).over(frame).alias(name) for source, name in columns.items()])
        .where(F.col(_SIDE) == 1)
        .select(*df.columns, *columns.values())
    )


def next_row(
    df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds, under new names, columns of the row just after in the key; ``columns`` maps source to new name.

    The order is walked from its end: what a block looks ahead to comes from the summary of the block after it.
    """
    turned = df.withColumn("_turned", -F.col(order))
    return previous_row(turned, keys, "_turned", columns, block_rows).drop("_turned")


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    size: int,
    aggregates: dict[str, Column],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Aggregates over each row and its ``size - 1`` predecessors in the key.

    Rows are numbered, cut into blocks of equal length, and the last
    ``size - 1`` rows of a block are copied into the next as its look-back.
    """
    numbered = ordinals(df, keys, order, "_ordinal", block_rows)
    # a block is at least as long as the frame, so a row's look-back starts no earlier than the block before
    length = F.lit(max(block_rows, size))
    own = F.floor((F.col("_ordinal") - 1) / length).cast("bigint")
    left_in_block = length - (F.col("_ordinal") - 1) % length
    homes = F.when(left_in_block < size, F.array(own, own + 1)).otherwise(F.array(own))
    frame = _within(keys, "_ordinal").rowsBetween(-(size - 1), 0)
    return (
        numbered.select("*", own.alias("_own"), F.explode(homes).alias(_BLOCK))
        .select("*", *[agg.over(frame).alias(name) for name, agg in aggregates.items()])
        .where(F.col("_own") == F.col(_BLOCK))
        .select(*df.columns, *aggregates)
    )


def last_rows(
    df: DataFrame, keys: Sequence[str], order: str, count: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The last ``count`` rows of each key, first thinned per block so that no key is ranked whole."""
    blocks = Window.partitionBy(*keys, _BLOCK).orderBy(F.col(order).desc())
    whole = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return (
        df.withColumn(_BLOCK, block_of(order, block_rows))
        .withColumn("_rank", F.row_number().over(blocks))
        .where(F.col("_rank") <= count)
        .withColumn("_rank", F.row_number().over(whole))
        .where(F.col("_rank") <= count)
        .select(*df.columns)
    )
