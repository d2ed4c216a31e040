"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import join_groups, scratch


def _least(links: DataFrame, total: int) -> DataFrame:
    """(u, v, m): every link with the smallest of u and its partners; the links of a node of many partners stay spread."""
    least = links.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_groups(links, least, ["u"], "n", total)


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of the (a, b) links that isn't itself the smallest of its component.

    Each step writes the links that remain, so a lost executor repeats one step
    at most; the number of steps grows with the logarithm of the longest path.
    """
    state = scratch(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = _mark(state)
    while mark[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, 2 * mark[0]).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch(large.distinct(), "links")
        near = _least(large, mark[0])
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(near.select("u", F.col("m").alias("v")))
        after = scratch(small.distinct(), "links")
        last, mark, state = mark, _mark(after), after
        if mark == last:
            break
    return state.select(F.col("u").alias("id"), F.col("v").alias("component"))
