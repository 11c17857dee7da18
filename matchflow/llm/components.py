"""Connected components of links, as rounds of joins and map-side combined minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for links (a, b): ``component`` is the smallest node that can be reached.

    Links may repeat and point either way; nulls must be filtered out before. No link, no row. Each round hangs every
    node's neighbours below the smallest of them, first the larger ones and then the smaller ones, so that long
    chains shorten fast; it ends when nothing changes. Only counts come to the driver.
    """
    pairs = (links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .where("u <> v").distinct())
    pairs = stored(pairs, "links")
    last = None
    for _ in range(rounds):
        # Larger neighbours of a node go below the smallest node in its neighbourhood.
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u <> v").distinct()
        # Smaller neighbours and the node itself go below the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            low.select("u", F.col("low").alias("v")))
        before, pairs = pairs, stored(small.where("u <> v").distinct(), "links")
        forget(before)
        # A fingerprint of the set of links tells whether a round has changed it.
        now = pairs.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(CAST(hash(u, v) AS BIGINT))")).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components have not settled; give more rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
