"""Connected components of a link table, by alternating large and small stars.

Every step keeps the components and shortens the paths to each component's smallest
node.  A node's minimum is taken with partial minima; its links are dealt over parts by their other end, and
the minimum goes to each of these parts: a node with very many links is no hot group.  No more links than
the input has are ever made.  State is written to the shared folder, so its size is known to
the next step's joins, in as many files as the links need.  The minima of a step also tell whether all links are
stars, where the steps end; a half step takes one wide aggregate beside its join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import observed
from . import common as C


#: Parts that the links of one node are dealt over.
PARTS = 256


def _save(links: DataFrame) -> DataFrame:
    return C.stored(links, "links")


def _part() -> Column:
    return F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")


def _least(links: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """((u, part, m): the smallest v of each u, for each part of u's links; whether some node has a second smaller
    neighbour, or both smaller and larger ones)."""
    least = (links.withColumn("part", _part()).groupBy("u")
             .agg(F.min("v").alias("m"), F.collect_set("part").alias("part"),
                  (F.sum((F.col("v") < F.col("u")).cast("int")) + F.max((F.col("v") > F.col("u")).cast("int"))).alias("ends"))
             .select("u", "m", F.explode("part").alias("part"), "ends"))
    rows, seen = observed(C.narrowed(least, n), ends=F.max("ends"))
    return C.stored(rows.drop("ends"), "least"), (seen.get["ends"] or 0) > 1


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v, m): every link with the smallest v of its u."""
    return links.withColumn("part", _part()).join(least, ["u", "part"]).select("u", "v", "m")


def stars(links: DataFrame, most: int | None = None) -> DataFrame:
    """(u, v) links -> (node, component): the smallest node reachable, for the nodes that have a smaller one.

    ``most``: a bound of the links' number, where it is known."""
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, n = C.counted(links if most is None else C.narrowed(links, most), _save)
    while True:
        both = edges.union(edges.select("v", "u"))
        least, more = _least(both, n)
        if not more:
            return edges.toDF("node", "component")
        # large star: all larger neighbours of a node go to the smallest of its neighbourhood
        large = _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = _save(C.narrowed(large, n))
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        near = _with_least(large, _least(large, n)[0])
        small = near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = _save(C.narrowed(small.distinct(), n))


def components(links: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component): the smallest node reachable, for nodes with links."""
    found = stars(links)
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
