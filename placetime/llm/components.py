"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written

MOST_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each linked node can reach; nodes without links are left out.

    Every round keeps at most one row a link and is written to the shared folder.  Minima are taken with
    map-side partials, so a node with very many links is no hot group.  Null ends and self-links are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, before = written(edges, "links"), None
    for _ in range(MOST_ROUNDS):
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("k"), F.least("u", "low").alias("low"))
        # large star: larger neighbours go to the smallest neighbour
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("k"), "low")
        small = large.join(least, F.col("u") == F.col("k"))
        edges = written(small.select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v")).where("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError("the links did not come to rest")
