"""Connected components of an edge table, by alternating large and small stars.

Each round replaces edges by edges to the least neighbour, until every node of a
component points at the component's least node. A node with very many neighbours is
safe: the least neighbour is an aggregate with a partial step, and the join that hands
it back can be split by adaptive execution. Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import stored


def _with_least(pairs: DataFrame) -> DataFrame:
    """``u``, ``v``, ``m``: with the least ``v`` of each ``u``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "u2")
    # A changed key makes Spark deal both sides anew, so that it may split a large one.
    own = lambda c: F.col(c).bitwiseXOR(F.lit(1).cast("long"))
    return pairs.join(least, own("u") == own("u2")).select("u", "v", "m")


def _stars(pairs: DataFrame) -> bool:
    """Whether each ``u`` of some distinct pairs has one ``v``, which is no pair's ``u``: no round changes such a table."""
    ends = pairs.select("u", F.lit(1).alias("n")).unionByName(pairs.select(F.col("v").alias("u"), F.lit(0).alias("n")))
    of = ends.groupBy("u").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    return of.agg(F.count_if((F.col("n") > 1) | (F.col("n") > F.col("least")))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least node of its component) for each node that has an edge to another node.

    ``edges`` has columns ``u`` and ``v`` of type long, in any direction, repeats
    allowed. An empty edge table gives an empty result.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # At most a row for each edge: repeats go with those of the small star.
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = stored(large.where("u <> v"), "large-star")
        starred = _with_least(large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "small-star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
