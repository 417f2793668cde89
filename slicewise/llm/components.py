"""Connected components by alternating large-star and small-star steps on a table of links.

Both steps are a grouped minimum and an equi-join, so that a node with very many links
is reduced on the map side and split by the skew join; nothing is collected. Every
round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.session import durable


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v) with u > v: hang neighbours on the smallest one."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    if large:
        hung = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return hung.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with a link; the component is its smallest node."""
    now = durable(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = _digest(now)
    while True:
        now = durable(_star(_star(now, True), False), "links")
        next_seen = _digest(now)
        if next_seen == seen:
            break
        seen = next_seen
    # at the fixed point every link leads to the component's smallest node
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
