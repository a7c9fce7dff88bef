"""Connected components of a graph given by its links, by alternating stars.

Each round sends a node's larger neighbours to the smallest node around it, then
its smaller ones; when the links stay the same they form stars whose centres are
the smallest nodes of their components. Minima are summed up map-side before the
shuffle; links of a hub meet its minimum in an equi-join whose large partitions
adaptive execution splits. Lineage is cut in the shared folder every round.

Null nodes are dropped, loops and repeated links are harmless, and nodes without
links don't appear in the result; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(links: DataFrame) -> tuple:
    """Tells one set of links from another: their number and sums of two hashes."""
    parts = [F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")) for k in (1, 2)]
    return tuple(links.agg(F.count(F.lit(1)), *parts).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each linked node; ``links`` has two columns of one type."""
    a, b = links.columns
    u = F.greatest(a, b)
    now = cut(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are kept as tables: then a join has nothing but exchanges under it, and a hub's links can be split.
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # Larger neighbours of u go to the smallest node around u.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Smaller neighbours of u, and u, go to the smallest of them.
        large = cut(large)
        lower = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
