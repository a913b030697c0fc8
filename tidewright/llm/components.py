"""Connected components of a link table by alternating large-star and small-star steps.

Every step is aggregation and equi-joins on DataFrames; links never reach the driver, which only compares a count and a
checksum of the link table to see the fixed point. The state between rounds is a Parquet table in the shared folder.

The centre of a large star has a row for each of its leaves. Rows of such nodes aren't shuffled to be joined: the nodes
are so few, whatever the number of links, that their smallest neighbours are broadcast.

Defined results: links of a node with itself or without a node are left out; repeated links count once; no links give no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import discard, hot_join, written


def _large_star(links: DataFrame, n: int) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return hot_join(both.where("b > a"), least, ["a"], 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    return row[0], row[1] or 0


def components(links: DataFrame) -> DataFrame:
    """From links (a long, b long): (node, component) for every node that has a link to another; component is the
    smallest node reachable. No links give no rows."""
    state = written(links.where("a <> b").select("a", "b").distinct(), "links")
    mark = _mark(state)
    while mark[0]:
        after = written(_small_star(_large_star(state, mark[0])).where("a <> b").distinct(), "links")
        now = _mark(after)
        discard(state)
        state = after
        if now == mark:
            break
        mark = now
    found = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
