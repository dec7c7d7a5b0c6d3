"""Memory registration: slots, the registration stack and capacities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestep.operators.lists import placed


def allocated(slots: DataFrame) -> DataFrame:
    """Slot ids in the order of registration: even for global slots, odd for local ones. ``slots`` has pid, kind, seq."""
    nth = placed(slots, ["pid", "kind"], "seq", name="_nth")
    return nth.withColumn("slot", ((F.col("_nth") - 1) * 2 + F.when(F.col("kind") == "local", 1).otherwise(0)).cast("long")).drop("_nth")


def over_capacity(slots: DataFrame, capacity: int) -> DataFrame:
    """Processes with more slots than they reserved."""
    return slots.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > capacity)


def message_load(bag: DataFrame, capacity: int) -> DataFrame:
    """Requests that count on each process (at origin and at target), and whether they fit what it reserved."""
    ends = bag.select(F.explode(F.array("src_pid", "dst_pid")).alias("pid"))
    return ends.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).withColumn("over", F.col("n") > capacity)


def live(slots: DataFrame, freed: DataFrame) -> DataFrame:
    """Slots that were not deregistered."""
    return slots.join(freed.select("pid", "slot"), ["pid", "slot"], "left_anti")


def stack_top(pushes: DataFrame) -> DataFrame:
    """The newest registration of each (pid, ident): ``depth`` and ``size``. An aggregate with a partial step."""
    return pushes.groupBy("pid", "ident").agg(F.max("depth").alias("depth"), F.max_by("size", "depth").alias("size"))


def popped(pushes: DataFrame, pops: DataFrame) -> DataFrame:
    """What is on top after as many of the newest were removed as ``pops`` (pid, ident, n) says. Pops take effect at the sync."""
    order = Window.partitionBy("pid", "ident").orderBy(F.desc("depth"))
    left = pushes.withColumn("nth", F.row_number().over(order)).join(pops, ["pid", "ident"], "left").where(F.col("nth") > F.coalesce("n", F.lit(0)))
    return stack_top(left)


def active(slots: DataFrame, step: int | Column) -> DataFrame:
    """Slots that can be used in a superstep: local ones at once, global ones from the sync after their registration."""
    return slots.where((F.col("kind") == "local") | (F.col("active_from") <= step))


def reserve(df: DataFrame) -> DataFrame:
    """The largest need of any process, for all: columns pid and need."""
    return df.groupBy("pid").agg(F.count(F.lit(1)).alias("own")).withColumn("need", F.max("own").over(Window.partitionBy()))
