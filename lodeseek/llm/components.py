"""Connected components of a link table by alternating large and small stars.

Every step is an aggregation (combined before the shuffle) and a lookup that deals
hot nodes out (``common.attach``); edges are written after each step, so a lost
executor costs one step. No list of links or components reaches the driver: it
sees a count per step, of nodes that do not hang on a centre yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import attach
from lodeseek.workspace import saved


def _lowest(edges: DataFrame, path: str) -> DataFrame:
    """(u, v, low): each directed edge with the lowest of its node's neighbours and itself."""
    lows = saved(
        edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count("*").alias("n")),
        path,
    )
    total = lows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return attach(edges, lows, "u", ["low"], "n", total)


def _unsettled(edges: DataFrame) -> int:
    """How many nodes of (u, v) edges, v < u, have several lower neighbours, or lower and higher ones.

    Without any, the edges are stars around their lowest nodes.
    """
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("lower"), F.lit(0).alias("higher"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    met = ends.groupBy("node").agg(F.sum("lower").alias("lower"), F.max("higher").alias("higher"))
    return met.where("lower > 1 OR lower + higher > 1").count()


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node of (u, v) links; a root is its component's lowest node.

    Links of a node with itself add the node; repeated links count once; an empty
    table gives no row.
    """
    given = saved(links.select("u", "v").distinct(), f"{folder}/0")
    nodes = given.select(F.col("u").alias("node")).union(given.select("v")).distinct()
    both = F.col("u") != F.col("v")
    lower = (F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = given.where(both).select(*lower).distinct()
    step = 0
    while _unsettled(edges):
        step += 1
        large = (
            _lowest(edges.union(edges.select("v", "u")), f"{folder}/{step}-large")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .distinct()
        )
        large = saved(large, f"{folder}/{step}-l")
        down = large.where(both).select(*lower)
        small = _lowest(down, f"{folder}/{step}-small")
        edges = saved(
            small.select(F.col("v").alias("u"), F.col("low").alias("v"))
            .union(small.select("u", F.col("low").alias("v")))
            .where(both)
            .distinct(),
            f"{folder}/{step}-s",
        )
    root = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
    return nodes.join(root, "node", "left").select(
        "node", F.coalesce("low", "node").alias("root")
    )
