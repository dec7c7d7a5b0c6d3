"""Supersteps over a stream: each micro-batch is the bag of one superstep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def last_writer(stream: DataFrame, cell: list[Column], value: Column, seq: Column) -> DataFrame:
    """The value that stays in each cell so far; state is one row a cell."""
    return stream.groupBy(*cell).agg(F.max_by(value, seq).alias("val"), F.count(F.lit(1)).alias("writers"))


def run_supersteps(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls ``step(bag, number)`` for each micro-batch in order; what it writes should depend on the number alone, as a batch may come again."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
