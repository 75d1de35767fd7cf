"""The blocked operators against plain windows, with blocks small enough to matter and one hot key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gustline.operators import ordered

BLOCKS = [1, 3, 10, 1 << 18]


@pytest.fixture(scope="module")
def rows(spark):
    rng, seq, data = random.Random(7), 0, []
    for _ in range(400):
        seq += rng.choice([1, 1, 2, 40])
        data.append(("hot" if rng.random() < 0.7 else rng.choice("ab"), seq, rng.choice([None, 1.0, 2.5, 4.0])))
    return spark.createDataFrame(data, "k string, seq bigint, v double").cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


@pytest.mark.parametrize("block", BLOCKS)
def test_running_totals(rows, block):
    window = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    same(ordered.running_totals(rows, ["k"], "seq", {"t": F.col("v")}, block), rows.withColumn("t", F.sum("v").over(window)))
    down = Window.partitionBy("k").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    same(
        ordered.running_totals(rows, ["k"], "seq", {"t": F.col("v")}, block, descending=True),
        rows.withColumn("t", F.sum("v").over(down)),
    )


@pytest.mark.parametrize("block", BLOCKS)
def test_ordinals_and_previous_row(rows, block):
    window = Window.partitionBy("k").orderBy("seq")
    same(ordered.ordinals(rows, ["k"], "seq", "n", block), rows.withColumn("n", F.row_number().over(window)))
    same(
        ordered.previous_row(rows, ["k"], "seq", {"v": "p", "seq": "q"}, block),
        rows.withColumn("p", F.lag("v").over(window)).withColumn("q", F.lag("seq").over(window)),
    )


@pytest.mark.parametrize("block", BLOCKS)
def test_rolling_and_last_rows(rows, block):
    window = Window.partitionBy("k").orderBy("seq").rowsBetween(-4, 0)
    same(
        ordered.rolling(rows, ["k"], "seq", 5, {"m": F.percentile("v", 0.5), "c": F.count("*")}, block),
        rows.withColumn("m", F.percentile("v", 0.5).over(window)).withColumn("c", F.count("*").over(window)),
    )
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("seq")))
    same(ordered.last_rows(rows, ["k"], "seq", 6, block), rows.withColumn("r", rank).where("r <= 6"))


@pytest.mark.parametrize("block", BLOCKS)
def test_asof_join(rows, block):
    right = rows.where("v = 4.0").select("k", "seq", F.col("seq").alias("at"), F.col("v").alias("w"))
    got = ordered.asof_join(rows, right, ["k"], "seq", ["at", "w"], block)
    hit = F.when(F.col("v") == 4.0, F.col("seq"))
    window = Window.partitionBy("k").orderBy("seq")
    want = rows.withColumn("at", F.last(hit, ignorenulls=True).over(window))
    same(got, want.withColumn("w", F.when(F.col("at").isNotNull(), 4.0)))


def test_rows_of_a_hot_key_spread_over_blocks(rows):
    plan = ordered.ordinals(rows, ["k"], "seq", "n", 10)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_block" in plan
