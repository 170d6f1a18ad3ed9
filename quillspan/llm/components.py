"""Connected components of a link table by Spark joins: contraction of minimum-neighbour forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import settle

#: Rows up to which a counted table of two keys is broadcast, about 20 MB; beyond that it is joined by sorting.
BROADCAST_ROWS = 200_000


def plain(df: DataFrame) -> DataFrame:
    """``df`` settled, without its plan's size estimate: a settled table keeps that, and each join to itself squares it, to numbers of millions of digits."""
    session, done = df.sparkSession, settle(df)._jdf
    return DataFrame(session._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), session)


def counted(df: DataFrame) -> DataFrame:
    """``df`` to be joined to: broadcast if its rows, counted, are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ordered(links: DataFrame) -> DataFrame:
    """Distinct links with a < b."""
    return links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``; the label is one of the component's nodes.

    Each round points every node at its least neighbour, if less than itself, follows the pointers to their roots by doubling,
    and renames the links by the roots; links inside one root go. A hub of any degree costs one row per link, with minima taken
    before the shuffle. The tables hold keys only and are written to the shared folder each round."""
    edges = plain(ordered(links))
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    labels = plain(labels)
    while edges.limit(1).count():
        up = plain(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))  # a < b, so pointers never form a ring
        while True:
            above = counted(up.select(F.col("node").alias("up"), F.col("up").alias("_top")))
            up = plain(up.join(above, "up", "left").select("node", F.coalesce("_top", "up").alias("up"), F.col("_top").isNotNull().alias("_more")))
            if not up.where("_more").limit(1).count():
                break
            up = up.drop("_more")
        up = counted(up.select("node", "up"))
        for name in ("a", "b"):
            edges = edges.join(up.withColumnRenamed("node", name), name, "left").withColumn(name, F.coalesce("up", name)).drop("up")
        edges = plain(ordered(edges))
        labels = plain(labels.join(up.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label")))
    return labels


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components of what gave ``labels(node, label)`` and of ``links(a, b)``: those of the labels that the links join."""
    both = links
    for name in ("a", "b"):
        both = both.join(labels.select(F.col("node").alias(name), F.col("label").alias("_l")), name, "left").withColumn(name, F.coalesce("_l", name)).drop("_l")
    joins = plain(ordered(both))
    if not joins.limit(1).count():
        return labels
    more = components(joins)
    fresh = more.select("node").join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("label"))
    return plain(labels.unionByName(fresh).join(counted(more.select(F.col("node").alias("label"), F.col("label").alias("_root"))), "label", "left").select("node", F.coalesce("_root", "label").alias("label")))
