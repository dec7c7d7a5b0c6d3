"""The cost of communication: h-relations, machine parameters and the choice of a plan."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestep.operators.lists import sample_sorted
from tidestep.sources.tables import kept, small

# The block sizes in bytes at which a machine is measured.
BLOCKS = (1, 8, 128, 1024, 8192, 131072, 1048576)


def h_relation(bag: DataFrame) -> DataFrame:
    """``step``, ``h``: the most that any process sends or receives. ``bag``: step, src_pid, dst_pid, size."""
    out = bag.select("step", F.col("src_pid").alias("pid"), F.col("size").alias("sent"), F.lit(0).cast("long").alias("got"))
    into = bag.select("step", F.col("dst_pid").alias("pid"), F.lit(0).cast("long"), F.col("size"))
    per = out.union(into).groupBy("step", "pid").agg(F.sum("sent").alias("sent"), F.sum("got").alias("got"))
    return per.groupBy("step").agg(F.max(F.greatest("sent", "got")).cast("long").alias("h"))


def program_cost(bag: DataFrame, g: int, l: int) -> DataFrame:  # noqa: E741
    """Sum over the supersteps of h g + l."""
    return h_relation(bag).agg(F.sum(F.col("h") * g + l).cast("long").alias("cost"))


def interpolated(wanted: DataFrame, curve: DataFrame) -> DataFrame:
    """``size``, ``g``, ``l`` between the two measured block sizes around each size; beyond the ends, the end's.

    ``curve`` (block, g, l) has a row for each of a few measured block sizes.
    """
    w = Window.orderBy("block")
    seg = curve.select("block", "g", "l", *(F.lead(c).over(w).alias(f"{c}2") for c in ("block", "g", "l")))
    first, last = (curve.agg(f(F.struct("block", "g", "l")).alias(n)) for f, n in ((F.min, "first"), (F.max, "last")))
    ends = first.join(small(last))
    rows = wanted.join(small(ends)).join(small(seg), (F.col("size") >= F.col("block")) & ((F.col("size") < F.col("block2")) | F.col("block2").isNull()), "left")
    part = (F.col("size") - F.col("block")) / (F.col("block2") - F.col("block"))
    line = lambda c: F.when(F.col("block").isNull(), F.col(f"first.{c}")).when(F.col("block2").isNull(), F.col(f"last.{c}")).otherwise(F.col(c) + part * (F.col(f"{c}2") - F.col(c)))
    return rows.select(*wanted.columns, line("g").alias("cost_g"), line("l").alias("cost_l"))


def machine_parameters(timings: DataFrame) -> DataFrame:
    """``block``, ``g``, ``l`` from timings (block, h, t): of each h-relation (three or more for a block, few in all) the least time counts.

    ``g`` is the slope between the two largest h-relations, the least positive double at
    least. ``l`` is what the line through the second and the third smallest has at h = 0, at
    most the time of the second, at least that of the smallest. Null with fewer relations.
    """
    best = timings.groupBy("block", "h").agg(F.min("t").cast("double").alias("t"))
    rows = best.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("h", "t"))).alias("x"))
    at = lambda i, f: F.try_element_at("x", F.lit(i))[f]
    slope = lambda i, j: F.try_divide(at(j, "t") - at(i, "t"), (at(j, "h") - at(i, "h")).cast("double"))
    gap, latency = F.greatest(F.lit(sys.float_info.min), slope(-2, -1)), at(2, "t") - slope(2, 3) * at(2, "h")
    enough = F.size("x") >= 3
    return rows.select("block", F.when(enough, gap).alias("g"), F.when(enough, F.greatest(at(1, "t"), F.least(at(2, "t"), latency))).alias("l"))


def budget_split(curve: DataFrame, seconds: float) -> DataFrame:
    """Time until which each block size may be measured: one hundredth in equal parts, the rest by size, cumulative."""
    every = curve.agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("total"))
    own = curve.join(small(every)).select("block", (F.lit(seconds) * (F.lit(0.01) / F.col("n") + F.lit(0.99) * F.col("block") / F.col("total"))).alias("own"))
    return own.select("block", F.sum("own").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)).alias("deadline"))


def statistics(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Number, mean, sample variance, third central moment and the 2.5 and 97.5 percentiles of each kind.

    ``value`` is a whole number. Moments come from exact sums about a whole number near
    the mean, so they do not depend on the order of the rows.
    """
    n, big = F.count(F.lit(1)), lambda c: c.cast("decimal(38,0)")
    centre = samples.groupBy(key).agg(F.floor(F.avg(value)).alias("c"))
    d = F.col(value) - F.col("c")
    per = samples.join(centre, key).groupBy(key, "c").agg(
        n.cast("long").alias("n"), F.sum(big(d)).cast("double").alias("s1"), F.sum(big(d * d)).cast("double").alias("s2"), F.sum(big(d) * big(d * d)).cast("double").alias("s3"),
    ).join(quantiles(samples, key, value, low=0.025, high=0.975), key)
    m = F.col("s1") / F.col("n")
    return per.select(
        key, "n", (F.col("c") + m).alias("mean"),
        F.try_divide(F.col("s2") - F.col("s1") * m, F.col("n") - 1).alias("variance"),
        ((F.col("s3") - F.col("s2") * 3 * m + F.col("s1") * 2 * m * m) / F.col("n")).alias("third"), "low", "high",
    )


def bucket_statistics(samples: DataFrame, key: str, bucket: str, value: str) -> DataFrame:
    """For each kind the number of buckets, the mean of all samples, the variance of the buckets' means about it, and the means themselves, sorted (their distribution).

    The number of buckets is that of a measurement plan, so the sorted means of a kind are a short array.
    """
    per = samples.groupBy(key, bucket).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(38,0)")).alias("s"))
    per = per.withColumn("m", F.col("s").cast("double") / F.col("n"))
    kinds = per.groupBy(key).agg(F.count(F.lit(1)).cast("long").alias("buckets"), (F.sum("s").cast("double") / F.sum("n")).alias("mean"), F.array_sort(F.collect_list("m")).alias("means"))
    spread = F.aggregate("means", F.lit(0.0), lambda s, m: s + (m - F.col("mean")) * (m - F.col("mean")))
    return kinds.select(key, "buckets", "mean", F.try_divide(spread, F.col("buckets") - 1).alias("variance_of_means"), "means")


def quantiles(samples: DataFrame, key: str, value: str, **shares: float) -> DataFrame:
    """For each kind the least values up to which at least the ``shares`` of its samples lie, exactly.

    Equal values are counted first, so a very common one is one row. The others are dealt in
    sorted ranges; a count up to a value is that of its range and of the ranges before.
    """
    counts = samples.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    ranged = kept(sample_sorted(counts, key, value), "counts")
    sums = ranged.groupBy(key, "range").agg(F.sum("_n").alias("_own"))  # a row for each kind and range
    before = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(key, "range", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_start"), F.sum("_own").over(Window.partitionBy(key)).alias("_all"))
    within = Window.partitionBy(key, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.join(small(starts), [key, "range"]).withColumn("_upto", F.col("_start") + F.sum("_n").over(within))
    return upto.groupBy(key).agg(*(F.min(F.when(F.col("_upto") >= F.col("_all") * share, F.col(value))).alias(name) for name, share in shares.items()))


def save_samples(samples: DataFrame, path: str) -> None:
    """Adds measured samples to those that a measurement has saved at ``path``, so that it can be resumed."""
    samples.write.mode("append").parquet(path)


def load_samples(like: DataFrame, path: str) -> DataFrame:
    """The saved samples, with the columns of ``like``."""
    return like.sparkSession.read.schema(like.schema).parquet(path)


def bsp_parameters(mean_empty: float, mean_p: float, mean_2p: float, mean_pn: float, mean_local: float, p: int, n: int) -> dict[str, float]:
    """``t0``, ``g``, ``L`` and ``r`` of a machine of p processes from the mean times of five measurements: nothing, p, 2 p and p n words exchanged, n words moved locally."""
    return {"t0": mean_empty, "g": (mean_pn - mean_2p) / (p * (n - 2)), "L": 2 * mean_p - mean_2p, "r": mean_local / (n * p)}


def broadcast_plan(machine: DataFrame) -> DataFrame:
    """The plan of a broadcast for each (p, size, g, l): one step only if cheaper than both others; else a tree if there are fewer bytes than processes, else stripes."""
    one = F.col("p") * F.col("size") * F.col("g") + F.col("l")
    tree = F.lit(2.0) * F.sqrt("p") * F.col("size") * F.col("g") + F.col("l") * 2
    striped = F.col("size") * 3 * F.col("g") + F.col("l") * 2
    return machine.withColumn("plan", F.when((one < tree) & (one < striped), "one_step").when(F.col("size") < F.col("p"), "tree").otherwise("striped"))


def traffic(procs: DataFrame, pattern: str, p: int, root: int = 0, side: int | None = None) -> DataFrame:
    """``src_pid, dst_pid`` of a pattern over the stated processes: all, scatter, gather or grid (neighbours on a torus of ``side`` columns)."""
    src, dst = procs.select(F.col("pid").alias("src_pid")), procs.select(F.col("pid").alias("dst_pid"))
    if pattern == "grid":
        side = side or max(1, int(p**0.5))
        x, y = F.col("src_pid") % side, F.floor(F.col("src_pid") / side)
        high = max(1, p // side)
        cells = F.array(*((F.pmod(y + dy, F.lit(high)) * side + F.pmod(x + dx, F.lit(side))).cast("int") for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))))
        return src.where(F.col("src_pid") < side * high).select("src_pid", F.explode(F.array_distinct(cells)).alias("dst_pid"))
    every = src.join(small(dst))
    return {"all": every, "scatter": every.where(F.col("src_pid") == root), "gather": every.where(F.col("dst_pid") == root)}[pattern]


def message_bag(procs: DataFrame, pattern: str, p: int, n: int, size: int, collide: bool = False, seed: int = 1) -> DataFrame:
    """The puts of an exchange benchmark: ``src_pid``, ``i``, ``dst_pid``, ``src_off``, ``dst_off``, ``size``; n messages for each destination, or n in all for grid and random.

    Grid sends in turn to the processes q on, q back, next and previous, where q is the whole
    part of the root of p. Random destinations are drawn by a congruence from seed, process
    and message. No process sends to itself. A writer has cells of its own on the receiver;
    with ``collide`` all writers use the same.
    """
    own = procs.select(F.col("pid").alias("src_pid"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    src, q = F.col("src_pid"), max(1, math.isqrt(p))
    turn = lambda *xs: F.get(F.array(*(F.pmod(x, F.lit(p)) for x in xs)), F.col("i") % len(xs))
    if pattern == "grid":
        bag = own.withColumn("dst_pid", turn(src + q, src - q, src + 1, src - 1))
    elif pattern == "random":
        bag = own.withColumn("dst_pid", drawn(src.cast("long") * n + F.col("i") + seed * 1_000_003, p))
    else:
        pairs = traffic(procs, pattern, p)
        bag = own.join(pairs, "src_pid")
    owner = F.col("dst_pid") if collide else src
    at = lambda who: (who.cast("long") * n + F.col("i")) * size
    return bag.where(F.col("dst_pid") != src).select("src_pid", "i", F.col("dst_pid").cast("int").alias("dst_pid"), at(src).alias("src_off"), at(owner).alias("dst_off"), F.lit(size).cast("long").alias("size"))


def drawn(x: Column, below: int) -> Column:
    """A number from 0 to ``below`` - 1 by two rounds of a congruence over 2^31, from the upper bits."""
    for _ in range(2):
        x = (x % (1 << 31) * 1103515245 + 12345) % (1 << 31)
    return F.shiftright(x * below, 31)
