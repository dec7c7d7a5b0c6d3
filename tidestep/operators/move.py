"""One-sided reads and writes, and the superstep that carries them out.

Memory is a relation ``mem(pid, slot, off, val)``. Requests are a relation
``bag(phase, seq, src_pid, src_slot, src_off, dst_pid, dst_slot, dst_off, size)``; a put
and a get differ only in who asks. ``sync`` reads sources from the memory as it was,
lets one writer of each cell win and returns the new memory. Any serialisation of
conflicting writes is legal; here the order is (phase, seq), and the last stays. In the
library with buffered requests gets have phase 0 and puts phase 1, so puts win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["pid", "slot", "off"]
REQUEST = ["phase", "seq", "src_pid", "src_slot", "src_off", "dst_pid", "dst_slot", "dst_off", "size"]
GET, PUT = 0, 1


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def requests(df: DataFrame, phase: int, seq, src: tuple, dst: tuple, size=1) -> DataFrame:
    """Requests made by the rows of ``df``; ``src`` and ``dst`` are (pid, slot, offset)."""
    kinds = ("int", "long", "int", "int", "long", "int", "int", "long", "long")
    values = (phase, seq, *src, *dst, size)
    return df.select(*(_col(v).cast(k).alias(n) for v, k, n in zip(values, kinds, REQUEST, strict=True)))


def put(df: DataFrame, seq, src: tuple, dst: tuple, size=1) -> DataFrame:
    return requests(df, PUT, seq, src, dst, size)


def get(df: DataFrame, seq, src: tuple, dst: tuple, size=1) -> DataFrame:
    return requests(df, GET, seq, src, dst, size)


def memory(df: DataFrame, pid, slot, off, val) -> DataFrame:
    return df.select(_col(pid).cast("int").alias("pid"), _col(slot).cast("int").alias("slot"), _col(off).cast("long").alias("off"), _col(val).alias("val"))


def elements(bag: DataFrame) -> DataFrame:
    """One row for each element that a request moves; requests of size zero have none."""
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1))
    rows = bag.where("size > 0").select(*REQUEST[:-1], each.alias("i"))
    return rows.select("phase", "seq", "src_pid", "src_slot", (F.col("src_off") + F.col("i")).alias("src_off"), "dst_pid", "dst_slot", (F.col("dst_off") + F.col("i")).alias("dst_off"))


def winners(bag: DataFrame) -> DataFrame:
    """``pid, slot, off`` of each written cell, the source cell ``s`` that stays and the number of writers.

    Conflicts are settled before any value is fetched, with a partial step ahead of the shuffle.
    """
    source = F.struct(F.col("src_pid").alias("pid"), F.col("src_slot").alias("slot"), F.col("src_off").alias("off"))
    return (
        elements(bag)
        .groupBy(F.col("dst_pid").alias("pid"), F.col("dst_slot").alias("slot"), F.col("dst_off").alias("off"))
        .agg(F.max_by(source, F.struct("phase", "seq")).alias("s"), F.count(F.lit(1)).alias("writers"))
    )


def sync(mem: DataFrame, bag: DataFrame) -> DataFrame:
    """The memory after the superstep. A write to a cell that is not registered has no effect, nor has a read of one."""
    old = mem.select(*(F.col(c).alias(f"old_{c}") for c in CELL), F.col("val").alias("new"))
    won = winners(bag).select(*CELL, *(F.col(f"s.{c}").alias(f"from_{c}") for c in CELL))
    read = won.join(old, [F.col(f"from_{c}") == F.col(f"old_{c}") for c in CELL]).select(*CELL, "new", F.lit(True).alias("hit"))
    return mem.join(read, CELL, "left").select(*CELL, F.when(F.col("hit"), F.col("new")).otherwise(F.col("val")).alias("val"))


def resolve(bag: DataFrame, slots: DataFrame) -> DataFrame:
    """Requests with slots replaced by their regions, and offsets by addresses: slots that alias then conflict as they must.

    ``slots`` has pid, slot, region and base.
    """
    out = bag
    for side in ("src", "dst"):
        s = slots.select(F.col("pid").alias(f"{side}_pid"), F.col("slot").alias(f"{side}_slot"), "region", "base")
        out = out.join(s, [f"{side}_pid", f"{side}_slot"]).withColumn(f"{side}_slot", F.col("region")).withColumn(f"{side}_off", F.col(f"{side}_off") + F.col("base")).drop("region", "base")
    return out.select(*REQUEST)
