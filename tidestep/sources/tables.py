"""Tables as the relations of bulk-synchronous programs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a session that runs in one process (master ``local`` or ``local[...]``)
    gets a temporary folder; on a cluster it is an error, since no other folder is known to be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "tidestep-shared")
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all executors share and read again; this cuts the lineage of an iteration."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def processes(spark: SparkSession, p: int) -> DataFrame:
    """The process relation: one row for each ``pid`` from 0 to p - 1."""
    return spark.range(p).select(F.col("id").cast("int").alias("pid"))


def small(df: DataFrame, most: int = 1 << 26) -> DataFrame:
    """``df``, to be broadcast if the planner's own figures bound its size by ``most`` bytes; else the planner chooses the join."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= most else df


def hooked(df: DataFrame, key: Column, p: int) -> DataFrame:
    """Adopts an existing DataFrame: adds the ``pid`` of each row, by a key that is not negative."""
    if p <= 0:
        raise ValueError("a positive number of processes")
    return df.withColumn("pid", (key % p).cast("int"))


def cents(col: str) -> Column:
    """An amount as a whole number, so that sums do not depend on their order."""
    return F.round(F.col(col) * 100).cast("long")


def owned(df: DataFrame, key: str, value: Column, p: int) -> DataFrame:
    """``pid``, ``off``, ``val``: rows dealt round-robin over the processes by a dense key."""
    return df.select((F.col(key) % p).cast("int").alias("pid"), F.expr(f"{key} div {p}").cast("long").alias("off"), value.alias("val"))
