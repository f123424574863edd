"""Connected components of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedview.session import pin


def _pairs(frame: DataFrame, a: str, b: str) -> DataFrame:
    return frame.where(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of (a, b) links, the root being the component's smallest node.

    Alternates two kinds of rounds (larger neighbours to the smallest neighbour, then smaller ones)
    until every component is a star. Each round is written to the shared folder, so lineage stays
    short and lost executors cost one round. No group is collected: rounds are a minimum and a join,
    and the join's hot keys are left to adaptive skew handling.
    """
    links, before = pin(_pairs(links, "a", "b"), "links"), None
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _pairs(both.join(least, "a").where("b > a"), "b", "m")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        links = pin(_pairs(joined, "b", "m").union(_pairs(small, "a", "m")).distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
