"""Collective operations over ``(pid, off, val)``; each is a projection, a shuffle on the new owner or an aggregate.

``procs`` are the processes that take part. It is made of a stated number of processes
and is the side that is broadcast where rows are copied to all of them, if its size is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestep.functions.reducers import reducer
from tidestep.sources.tables import small


def members(procs: DataFrame, lo: int, hi: int, stride: int) -> DataFrame:
    """``rank`` and ``pid`` of the processes lo, lo + stride, ... below hi."""
    return procs.where((F.col("pid") >= lo) & (F.col("pid") < hi) & ((F.col("pid") - lo) % stride == 0)).select(((F.col("pid") - lo) / stride).cast("int").alias("rank"), "pid")


def ranked(df: DataFrame, group: DataFrame) -> DataFrame:
    """Rows of the members of a group, with ranks in place of pids."""
    return df.join(small(group), "pid").select(F.col("rank").alias("pid"), "off", "val")


def everywhere(df: DataFrame, procs: DataFrame) -> DataFrame:
    """Each row once for each process, in ``pid``."""
    return df.drop("pid").join(small(procs.select("pid")))


def broadcast(df: DataFrame, procs: DataFrame, root: int) -> DataFrame:
    """The root's array on every other process."""
    return everywhere(df.where(F.col("pid") == root), procs.where(F.col("pid") != root)).select("pid", "off", "val")


def broadcast_tree(df: DataFrame, procs: DataFrame, root: int, p: int) -> DataFrame:
    """As ``broadcast``, in two hops: relays every sqrt(P) processes first, then their neighbours."""
    hop = max(1, int(p**0.5))
    order = procs.select("pid", F.pmod(F.col("pid") - root, F.lit(p)).alias("d"))
    relays = order.where(F.col("d") % hop == 0).select(F.col("d").alias("relay"))
    first = df.where(F.col("pid") == root).select("off", "val").join(small(relays))
    rest = order.where("d > 0").select("pid", (F.col("d") - F.col("d") % hop).alias("relay"))
    return first.join(small(rest), "relay").select("pid", "off", "val")


def broadcast_striped(df: DataFrame, procs: DataFrame, root: int, size: int, p: int) -> DataFrame:
    """As ``broadcast``, in two hops: each process takes one of p stripes of the root's ``size`` elements, then all hand theirs on (``via``).

    The stripes are an exchange of their own, so one large array does not leave from one task.
    """
    chunk = -(-size // p) or 1
    stripes = df.where(F.col("pid") == root).select(F.expr(f"off div {chunk}").cast("int").alias("via"), "off", "val").repartition("via")
    return stripes.join(small(procs.where(F.col("pid") != root).select("pid"))).select("pid", "via", "off", "val")


def gather(df: DataFrame, size: int, root: int) -> DataFrame:
    """Blocks of the other processes, one after another, on the root."""
    return df.where(F.col("pid") != root).select(F.lit(root).alias("pid"), (F.col("pid") * F.lit(size).cast("long") + F.col("off")).alias("off"), "val")


def scatter(df: DataFrame, size: int, root: int, p: int) -> DataFrame:
    """Block s of the root's array on process s; the root's own stays where it is."""
    rows = df.where((F.col("pid") == root) & (F.col("off") < F.lit(size).cast("long") * p))
    return rows.select(F.floor(F.col("off") / size).cast("int").alias("pid"), (F.col("off") % size).alias("off"), "val").where(F.col("pid") != root)


def allgather(df: DataFrame, procs: DataFrame, size: int, exclude_self: bool = False) -> DataFrame:
    """All blocks on every process."""
    own = df.select(F.col("pid").alias("src"), (F.col("pid") * F.lit(size).cast("long") + F.col("off")).alias("off"), "val")
    out = own.join(small(procs.select("pid")))
    return (out.where("pid <> src") if exclude_self else out).select("pid", "off", "val")


def allgatherv(df: DataFrame, procs: DataFrame) -> DataFrame:
    """All arrays, of any lengths, one after another on every process."""
    n = df.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    all_n = procs.select("pid").join(n, "pid", "left").select("pid", F.coalesce("n", F.lit(0)).alias("n"))
    start = all_n.select(F.col("pid").alias("src"), F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row for each process
    moved = df.withColumnRenamed("pid", "src").join(small(start), "src").select((F.col("start") + F.col("off")).alias("off"), "val")
    return everywhere(moved, procs).select("pid", "off", "val")


def alltoall(df: DataFrame, size: int, p: int) -> DataFrame:
    """Block s of process k becomes block k of process s; the diagonal stays untouched."""
    rows = df.where(F.col("off") < F.lit(size).cast("long") * p)
    dst = F.floor(F.col("off") / size).cast("int")
    return rows.where(dst != F.col("pid")).select(dst.alias("pid"), (F.col("pid") * F.lit(size).cast("long") + F.col("off") % size).alias("off"), "val")


def reduce(df: DataFrame, op, root: int) -> DataFrame:
    """All values of all processes into one, on the root."""
    return df.agg(reducer(op)(F.col("val")).alias("val")).select(F.lit(root).alias("pid"), "val")


def allreduce(df: DataFrame, procs: DataFrame, op) -> DataFrame:
    return everywhere(reduce(df, op, 0), procs).select("pid", "val")


def combine(df: DataFrame, op, root: int) -> DataFrame:
    """Element by element over the processes, on the root; partial aggregates are its tree."""
    return df.groupBy("off").agg(reducer(op)(F.col("val")).alias("val")).select(F.lit(root).alias("pid"), "off", "val")


def allcombine(df: DataFrame, procs: DataFrame, op) -> DataFrame:
    return everywhere(combine(df, op, 0), procs).select("pid", "off", "val")


def scan(df: DataFrame, procs: DataFrame, op="sum", exclusive: bool = False) -> DataFrame:
    """Prefix over the processes of the reduction of each; those without rows count as null."""
    own = df.groupBy("pid").agg(reducer(op)(F.col("val")).alias("val"))
    until = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)  # a row for each process
    return procs.select("pid").join(own, "pid", "left").select("pid", reducer(op)(F.col("val")).over(until).alias("val"))


def nested(df: DataFrame, sub: Column, p: int) -> DataFrame:
    """Rows on ``p`` inner processes of each process: ``sub_pid`` by a key that is not negative. A reduction by (pid, sub_pid), then by pid, runs in each subgroup."""
    return df.withColumn("sub_pid", (sub % p).cast("int"))


def reduce_nested(df: DataFrame, op) -> DataFrame:
    """What each subgroup reduces to: first on each inner process, then on its process (``inner`` of them took part)."""
    own = df.groupBy("pid", "sub_pid").agg(reducer(op)(F.col("val")).alias("val"))
    return own.groupBy("pid").agg(reducer(op)(F.col("val")).alias("val"), F.count(F.lit(1)).alias("inner"))


def any_flag(df: DataFrame, procs: DataFrame, condition) -> DataFrame:
    """Whether any row of any process has the condition, on every process."""
    return everywhere(df.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("val")), procs).select("pid", "val")


def local_count(df: DataFrame, procs: DataFrame) -> DataFrame:
    n = df.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    return procs.select("pid").join(n, "pid", "left").select("pid", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def imbalance(df: DataFrame, procs: DataFrame) -> DataFrame:
    """Largest less smallest number of rows of a process."""
    return local_count(df, procs).agg((F.max("n") - F.min("n")).alias("imbalance"))
