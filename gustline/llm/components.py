"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.staging import Staging


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    joined = edges.join(least, "hi")
    moved = joined.select(F.col("lo").alias("hi"), F.col("least").alias("lo")).filter("hi != lo")
    return joined.select("hi", F.col("least").alias("lo")).union(moved).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node to the smallest of them and itself."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def components(links: DataFrame, staging: Staging, name: str = "links") -> DataFrame:
    """node and component (its smallest node) of every node that a link (a, b) names.

    Each round is two joins on narrow rows, written to the shared folder; rounds grow with the logarithm of the
    number of nodes, and a hub's links are combined before they are shuffled.  No links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo").distinct()
    edges = staging.table(edges, f"{name}-0")
    seen, turn = None, 0
    while True:
        sign = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(hi, lo))").alias("x")).first()
        if (sign.n, sign.x) == seen or not sign.n:
            break
        seen, turn = (sign.n, sign.x), turn + 1
        edges = staging.table(_small_star(_large_star(edges)), f"{name}-{turn}")
        staging.drop(f"{name}-{turn - 1}")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
