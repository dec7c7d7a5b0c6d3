"""Tagged messages: ``queue(src_pid, dst_pid, seq, tag, payload, size)``.

Messages sent in a superstep can be read in the next. The order of reading is free;
here it is by sender, and of one sender the last message first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidestep.operators.lists import placed

#: Bytes before each message that hold its length.
HEADER = 8


def send(df: DataFrame, src, dst, seq, tag, payload) -> DataFrame:
    return df.select(src.cast("int").alias("src_pid"), dst.cast("int").alias("dst_pid"), seq.cast("long").alias("seq"), tag.alias("tag"), payload.alias("payload"), F.coalesce(F.octet_length(payload), F.lit(0)).cast("long").alias("size"))


def full_flags(queue: DataFrame, capacity: int) -> DataFrame:
    """``src_pid``, ``dst_pid``, ``seq``, ``used`` and ``full``: whether each message is refused, and the bytes used in its region after it.

    Each (sender, receiver) has a region of ``capacity`` bytes. A message that does not fit is
    refused and leaves the region as it was, so a later, smaller one may still fit. That depends
    on each message before, so a task streams the messages of a pair in order and keeps one number.
    """
    need = F.lit(HEADER) + F.coalesce(F.octet_length("tag"), F.lit(0)) + F.col("size")
    rows = queue.select("src_pid", "dst_pid", "seq", need.cast("long").alias("need")).repartition("src_pid", "dst_pid").sortWithinPartitions("src_pid", "dst_pid", "seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used = None, 0
        for batch in batches:
            src, dst, seq, needs = (x.to_pylist() for x in batch.columns)
            kept, full = [], []
            for s, d, n in zip(src, dst, needs, strict=True):
                if (s, d) != at:
                    at, used = (s, d), 0
                full.append(used + n > capacity)
                used += 0 if full[-1] else n
                kept.append(used)
            yield pa.record_batch([*batch.columns[:3], pa.array(kept, pa.int64()), pa.array(full, pa.bool_())], names=["src_pid", "dst_pid", "seq", "used", "full"])

    return rows.mapInArrow(fold, "src_pid int, dst_pid int, seq long, used long, full boolean")


def delivered(queue: DataFrame) -> DataFrame:
    """``place`` of each message in the order of reading on its receiver."""
    return placed(queue, ["dst_pid"], "src_pid", F.desc("seq"))


def remaining(queue: DataFrame, moves: DataFrame) -> DataFrame:
    """The messages left after each process has moved or discarded ``n`` of its own (``moves``: pid, n), in the order of reading."""
    return delivered(queue).join(moves.select(F.col("pid").alias("dst_pid"), "n"), "dst_pid", "left").where(F.col("place") > F.coalesce("n", F.lit(0))).drop("n", "place")


def sync_all(queues: dict[str, DataFrame]) -> DataFrame:
    """Several queues in one exchange, told apart by ``queue``."""
    out = None
    for name, q in queues.items():
        own = q.withColumn("queue", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out.repartition("dst_pid", "queue")


def queue_size(queue: DataFrame, procs: DataFrame) -> DataFrame:
    """Number of messages and payload bytes that wait on each process."""
    n = queue.groupBy(F.col("dst_pid").alias("pid")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    zero = F.lit(0).cast("long")
    return procs.select("pid").join(n, "pid", "left").select("pid", F.coalesce("n", zero).alias("n"), F.coalesce("bytes", zero).alias("bytes"))


def peeked(queue: DataFrame, procs: DataFrame) -> DataFrame:
    """Status (payload bytes, or -1 without a message) and tag of the message that is read first; an aggregate, not a sort."""
    first = queue.groupBy(F.col("dst_pid").alias("pid")).agg(F.min_by(F.struct("size", "tag"), F.struct("src_pid", -F.col("seq"))).alias("m"))
    return procs.select("pid").join(first, "pid", "left").select("pid", F.coalesce("m.size", F.lit(-1).cast("long")).alias("status"), F.col("m.tag").alias("tag"))


def moved(queue: DataFrame, most: int) -> DataFrame:
    """Payloads as bytes cut to ``most`` of them, with the number of bytes before. ``remaining`` has what is left of the queue."""
    raw = F.col("payload").cast("binary")
    return queue.select("src_pid", "dst_pid", "seq", F.substring(raw, 1, most).alias("payload"), F.coalesce(F.octet_length(raw), F.lit(0)).cast("long").alias("length"))


def hp_moved(queue: DataFrame, moves: DataFrame) -> DataFrame:
    """Tag, payload and size of the messages that ``moves`` (pid, n) takes from the queue, in place: none is cut or copied."""
    taken = delivered(queue).join(moves.select(F.col("pid").alias("dst_pid"), "n"), "dst_pid").where(F.col("place") <= F.col("n"))
    return taken.select("dst_pid", "place", "src_pid", "seq", "tag", "payload", "size")


def volume(log: DataFrame, kinds: list[str]) -> DataFrame:
    """Requests of each kind and payload bytes for each (source, destination): ``log`` has src_pid, dst_pid, kind and size."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    return log.groupBy("src_pid", "dst_pid").agg(*counts, F.sum("size").cast("long").alias("bytes"))


#: The kinds of requests whose volumes a superstep exchanges.
KINDS = ("put", "hpput", "get", "hpget", "send", "hpsend")


def request_volume(log: DataFrame) -> DataFrame:
    """For each (source, destination) the requests of the six kinds, the bytes of buffered gets and of sends, and the messages they make (a send makes two)."""
    bytes_of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("size"))), F.lit(0)).cast("long")
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    out = log.groupBy("src_pid", "dst_pid").agg(*counts, bytes_of("get").alias("get_payload"), bytes_of("send", "hpsend").alias("send_payload"))
    return out.withColumn("messages", sum((F.col(k) for k in KINDS[1:4]), F.col(KINDS[0])) + (F.col("send") + F.col("hpsend")) * 2)


def demoted(messages: DataFrame, budget: int) -> DataFrame:
    """``messages`` (src_pid, seq, size, ...) and ``buffered``: of the unbuffered messages of each process the ``budget`` largest stay so, by ``seq`` among equals.

    Only those are ranked: each task keeps at most ``budget`` of a process before the exchange.
    """
    order = Window.partitionBy("src_pid").orderBy(F.desc("size"), "seq")
    largest = messages.select("src_pid", "seq", "size").withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget)
    largest = largest.select(F.col("src_pid").alias("_src"), F.col("seq").alias("_seq"))
    joined = messages.join(largest, (F.col("src_pid") == F.col("_src")) & (F.col("seq") == F.col("_seq")), "left")
    return joined.withColumn("buffered", F.col("_seq").isNull()).drop("_src", "_seq")


def tag_sizes(settings: DataFrame) -> DataFrame:
    """``tag_size`` of each superstep: the last that each process set, which must agree (null if not)."""
    last = settings.groupBy("step", "pid").agg(F.max_by("tag_size", "seq").alias("n"))
    return last.groupBy("step").agg(F.when(F.min("n") == F.max("n"), F.max("n")).alias("tag_size"), (F.min("n") != F.max("n")).alias("mismatch"))
