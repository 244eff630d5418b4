"""Connected components of links, as joins and aggregations that end in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm._io import dropped, hot_keys, looked_up, written


def _to_lowest(rows: DataFrame, edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """rows (u, v) as (v, low) with u's lowest neighbour in edges (u counts), and (u, low) of every u. A hub's rows aren't gathered."""
    found = edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("rows"))
    low = found.select("u", F.least("u", "low").alias("low"))
    return looked_up(rows, low, "u", hot_keys(found, "u", total)).select(F.col("v").alias("u"), F.col("low").alias("v")), low.select("u", F.col("low").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links(u, v); component is the smallest id that links reach.

    Alternates large-star and small-star steps, which shorten every path to its lowest
    end; the number of rounds grows with the logarithm of the longest path. Each round
    ends in a table, and the tables before it are deleted.
    """
    state = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = written(links.select("u", "v").filter("u != v").distinct(), "links")
    before, now = None, state(edges)
    while now != before:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = _to_lowest(both.filter("v > u"), both, 2 * now[0])
        down = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "links")
        small, own = _to_lowest(down, down, now[0])
        after = written(small.union(own).filter("u != v").distinct(), "links")
        dropped(down)
        dropped(edges)
        edges, before, now = after, now, state(after)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
