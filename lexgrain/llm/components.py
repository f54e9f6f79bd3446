"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, hot_from, join_by_heat, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(links: DataFrame) -> DataFrame:
    """(u, m, heat): the least v of each u, and how many links it has; pre-aggregated before the shuffle."""
    return links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("heat"))


def components(edges: DataFrame) -> DataFrame:
    """Columns a, b of any orderable type are links; gives (node, root), root being the smallest node reached.

    Only nodes with a link to another node appear. Every round keeps at most one row for each link. Minima are
    pre-aggregated, and a node with very many links gets its minimum by broadcast: its links stay where they are.
    Empty input, self-links and repeated links are fine; links with a null end are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialize(edges.distinct(), "links")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hot = hot_from(2 * now[0])
        lowest = _least(both).withColumn("m", F.least("u", "m"))
        # links (v, u) of a local minimum u stay as they are: m = u there
        large = join_by_heat(both, lowest, "u", "heat", hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "links")
        least = _least(large)
        small = join_by_heat(large, least, "u", "heat", hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        done, edges = edges, materialize(small.distinct(), "links")
        discard(done, large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
