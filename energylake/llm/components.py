"""Connected components of a link table, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, new_path, stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b) but the roots themselves.

    The root of a component is its smallest node.  A large star links all greater
    neighbours of a node to the least of its neighbourhood, a small star all lesser ones; links
    only ever move to smaller nodes and never become more.  The rounds end when nothing
    moves, which takes about log(longest path) rounds.  Each round is staged, so a
    lost executor costs no earlier round.
    """
    spark = links.sparkSession
    path = new_path(spark, "links")
    now = stage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
        "links",
        path,
    )
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m"))
        large = (
            both.join(least, "v")
            .filter("u > v")
            .select(F.col("u").alias("v"), F.least("v", "m").alias("u"))
            .distinct()
        )
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select("x.v", F.col("x.m").alias("u"))
            .filter("v <> u")
            .distinct()
        )
        new_place = new_path(spark, "links")
        now, before, old = stage(small, "links", new_place), mark, path
        path = new_place
        mark = _mark(now)
        discard(spark, old)
        if mark == before:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _mark(links: DataFrame) -> tuple[int, int]:
    """Number of links and a sum over all of them: equal if nothing has moved."""
    row = links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
    ).first()
    return row[0], row[1] or 0
