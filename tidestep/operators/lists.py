"""Distributed sorting, ranking and linked lists.

A list is the relation ``list(id, next)``; the last node has a null ``next``. Positions
count from zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestep.sources.tables import kept, small


def sample_sorted(df: DataFrame, *keys: str | Column, parts: int | None = None) -> DataFrame:
    """Rows in ranges by sampled pivots, each range sorted, with the number of the range in ``range``."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys).withColumn("range", F.spark_partition_id()).sortWithinPartitions(*keys)


def ranked(df: DataFrame, *keys: str | Column, name: str = "rank") -> DataFrame:
    """Position of each row in the order of ``keys`` (which must be total), without one task that sees all rows.

    Rows are dealt by sampled pivots and sorted once; a row's number in its sorted range, and
    the range, are in one id, which is stored with the row. Its rank is that number plus the
    sizes of the ranges before, of which there are as many as shuffle partitions.
    """
    at, n, before = F.shiftrightunsigned("_at", 33), F.count(F.lit(1)), Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ordered = kept(sample_sorted(df, *keys).drop("range").withColumn("_at", F.monotonically_increasing_id()), "sorted")
    sizes = ordered.groupBy(at.alias("_range")).agg(n.alias("n"))
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    own = ordered.join(small(starts), at == F.col("_range"))
    return own.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_range", "_start")


def placed(df: DataFrame, group: list[str], *keys: str | Column, name: str = "place") -> DataFrame:
    """Place (from 1) of each row in its group by ``keys`` (a total order), however large a group is: its rank among all rows, less the rows of the groups before."""
    rows = kept(ranked(df, *group, *keys, name="_rank"), "ranked")
    first = rows.groupBy(*group).agg(F.min("_rank").alias("_first"))
    own = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]
    out = rows.join(first.withColumnsRenamed({g: f"_of_{g}" for g in group}), own)
    return out.withColumn(name, F.col("_rank") - F.col("_first") + 1).drop("_rank", "_first", *(f"_of_{g}" for g in group))


def links(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """``id``, ``prev``, ``next`` of the list in the order of the rows: each rank is joined to its neighbours'."""
    named = {f"_o{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    rows = df.select(F.col(key).alias("id"), *(v.alias(n) for n, v in named.items()))
    r = kept(ranked(rows, *named, name="place").select("id", "place"), "places")
    after = r.select((F.col("place") - 1).alias("place"), F.col("id").alias("next"))
    before = r.select((F.col("place") + 1).alias("place"), F.col("id").alias("prev"))
    return r.join(after, "place", "left").join(before, "place", "left").select("id", "prev", "next")


def _walk(nodes: DataFrame, kind: str) -> DataFrame:
    """``id`` and ``rank`` of a short list (id, next, far: the distance to the next), by following it in one task; null for nodes that its head does not lead to."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        after, rank = {i: (n, far) for i, n, far in rows}, {}
        heads = after.keys() - {n for n, _ in after.values()}
        at, place = (next(iter(heads)), 0) if len(heads) == 1 else (None, 0)
        while at is not None:
            rank[at] = place
            at, place = after[at][0], place + after[at][1]
        yield pa.record_batch([pa.array([r[0] for r in rows], id_type), pa.array([rank.get(r[0]) for r in rows], pa.int64())], names=["id", "rank"])

    id_type = nodes.select("id").limit(0).toArrow().schema.field(0).type
    return nodes.select("id", "next", "far").repartition(1).mapInArrow(follow, f"id {kind}, rank long")


def list_rank(nodes: DataFrame, short: int = 1 << 16) -> DataFrame:
    """``id`` and ``rank`` of each node of a list, by contraction.

    Each round every node draws a coin from its id; a node with heads that follows one with
    tails is taken out, about a quarter of them, and remembered with its predecessor. A list of
    at most ``short`` nodes is followed in one task; then the nodes come back in reverse order,
    each behind its predecessor. All rounds together move a few times the list.

    A pointer to no node, and nodes that are not one list (a cycle, several heads), are a ValueError.
    """
    kind = dict(nodes.dtypes)["id"]
    now = kept(nodes.select("id", "next", F.lit(1).cast("long").alias("far")), "list")
    if not now.where("next IS NOT NULL").join(now.select(F.col("id").alias("_id")), F.col("next") == F.col("_id"), "left_anti").isEmpty():
        raise ValueError("a node points to one that is not in the list")
    taken, size = [], now.count()
    while size > short and len(taken) < 400:
        heads = lambda x, n=len(taken): F.xxhash64(F.lit(n), x) % 2 == 0
        out = now.where(F.col("next").isNotNull() & ~heads(F.col("id")) & heads(F.col("next"))).select(F.col("next").alias("gone"), F.col("id").alias("pred"), F.col("far").alias("back"))
        taken.append(kept(out, "taken"))
        both = now.join(taken[-1], F.col("id") == F.col("gone"), "left")
        spliced = both.where("pred IS NOT NULL").select("pred", F.col("next").alias("then"), F.col("far").alias("more"))
        left = both.where("pred IS NULL").select("id", "next", "far").join(spliced, F.col("id") == F.col("pred"), "left")
        cut = F.col("pred").isNotNull()
        now = kept(left.select("id", F.when(cut, F.col("then")).otherwise(F.col("next")).alias("next"), F.when(cut, F.col("far") + F.col("more")).otherwise(F.col("far")).alias("far")), "list")
        size = now.count()
    ranks = kept(_walk(now, kind), "ranks")
    if not ranks.where("rank IS NULL").isEmpty():
        raise ValueError("not one list: a cycle, or several heads")
    for out in reversed(taken):
        back = out.join(ranks, F.col("pred") == F.col("id")).select(F.col("gone").alias("id"), (F.col("rank") + F.col("back")).alias("rank"))
        ranks = kept(ranks.unionByName(back), "ranks")
    return ranks


def insert_before(nodes: DataFrame, new: DataFrame, *order: str | Column) -> DataFrame:
    """A list (id, prev, next) with the nodes ``new`` (id, before) inserted, any number before each node, in ``order`` (of ids if none is given).

    A null ``before`` appends; nodes before one that is not in the list are left out.
    """
    place = Window.partitionBy("before").orderBy(*(order or ("id",)))
    chain = new.select("id", "before", F.lag("id").over(place).alias("back"), F.lead("id").over(place).alias("then"))
    chain = chain.join(nodes.select(F.col("id").alias("_at")), F.col("before") == F.col("_at"), "left").where("before IS NULL OR _at IS NOT NULL").drop("_at")
    first = chain.where("back IS NULL").select(F.col("before").alias("_before"), F.col("id").alias("first"))
    last = chain.where("then IS NULL").select(F.col("before").alias("_before"), F.col("id").alias("last"))
    relinked = nodes.join(last, F.col("id") == F.col("_before"), "left").select("id", F.coalesce("last", "prev").alias("prev"), "next")
    relinked = relinked.join(first, F.col("next").eqNullSafe(F.col("_before")), "left").select("id", "prev", F.coalesce("first", "next").alias("next"))
    ends = nodes.select(F.col("id").alias("_prev"), F.col("next").alias("_next"))
    added = chain.join(ends, F.col("back").isNull() & F.col("before").eqNullSafe(F.col("_next")), "left")
    return relinked.unionByName(added.select("id", F.coalesce("back", "_prev").alias("prev"), F.coalesce("then", "before").alias("next")))


def rebalanced(df: DataFrame, p: int, *order: str | Column) -> DataFrame:
    """Each row's new ``pid`` so that process s holds (n + p - s - 1) div p rows."""
    return ranked(df, *order, name="place").withColumn("pid", (F.col("place") % p).cast("int")).drop("place")


def relocated(nodes: DataFrame, p: int, *order: str | Column) -> DataFrame:
    """A list (id, prev, next) rebalanced: ``id``, its new place ``pid``, ``idx``, and both links as places (null at the ends)."""
    place = ranked(nodes, *order, name="place")
    at = kept(place.select("id", "prev", "next", (F.col("place") % p).cast("int").alias("pid"), F.expr(f"place div {p}").alias("idx")), "places")
    for side in ("prev", "next"):
        to = at.select(F.col("id").alias(f"_{side}"), F.col("pid").alias(f"{side}_pid"), F.col("idx").alias(f"{side}_idx"))
        place = at if side == "prev" else place
        place = place.join(to, F.col(side) == F.col(f"_{side}"), "left")
    return place.select("id", "pid", "idx", "prev_pid", "prev_idx", "next_pid", "next_idx")


def dumped(nodes: DataFrame) -> DataFrame:
    """A list (id, prev, next) with the ``rank`` of each node, found from its links; sorted by rank it is the list's print."""
    rank = list_rank(nodes.select("id", "next")).withColumnRenamed("id", "_id")
    return nodes.join(rank, F.col("id") == F.col("_id")).select("rank", "id", "prev", "next")


def random_list(spark, n: int, seed: int = 0) -> DataFrame:
    """The nodes 0 .. n - 1 as a list in a random order that the seed fixes."""
    keyed = spark.range(n).select("id", F.xxhash64(F.lit(seed), "id").alias("key"))
    return links(keyed, "id", "key", "id")
