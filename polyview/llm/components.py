"""Connected components of a table of links, by alternating star operations.

Every round turns links towards the smallest neighbour, first for larger, then for
smaller neighbours; the links end as stars around the smallest node of each
component after a number of rounds that grows with the logarithm of its diameter.
Rounds are joins and minima that are combined before the shuffle; nothing is
gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyview.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return (links.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select("a", F.col("m").alias("b"))).distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node that is not a root.

    links: a, b (long, not null).  Loops and repeated links are allowed.
    """
    links = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut_lineage(links)
    before = _state(links)
    while before[0]:
        links = cut_lineage(_small_star(_large_star(links)))
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
