"""Small helpers that the operators share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidestep.sources.tables import shared_dir

#: The white space of the line and word contracts, [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bytes of the rows that a Python worker gets at once; with long texts, the default number of rows would be far more.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by their size, for the rest of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as make it differ from all of ``taken``, whatever the case."""
    seen, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table in the shared folder and read again.

    This cuts the lineage: what follows survives the loss of executors without
    running the earlier steps again. Schema and rows are unchanged.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def process_cache(name: str) -> dict:
    """A dictionary that lives as long as this Python process."""
    return sys.__dict__.setdefault("_tidestep_caches", {}).setdefault(name, {})


def ascii_lower(col):
    """Lower-cases A-Z and nothing else."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, UPPER.lower())
    )


def with_text_columns(docs: DataFrame, text: str, make, added: list[tuple[str, str]], most: int = 1 << 20) -> DataFrame:
    """``docs`` with the columns ``added`` (names and SQL types) that ``make`` gives for some of its texts.

    ``make`` takes a string array of about ``most`` bytes at once (one text, if that is
    longer) and returns one Arrow array for each added column. All other columns pass
    through Arrow as they are; nothing is shuffled. The added columns come last, in order;
    a name that ``docs`` has already gets underscores behind it (``fresh``).
    """
    *names, whole = fresh(docs.columns, *(a for a, _ in added), "text_in")
    added = [*zip(names, (k for _, k in added), strict=True)]
    small_batches(docs.sparkSession)
    kept, names = docs.schema, [*docs.columns, *(a for a, _ in added)]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = pyarrow.compute.fill_null(pyarrow.compute.binary_length(texts), 0).to_pylist()
            start = size = 0
            for stop in range(1, len(sizes) + 1):
                size += sizes[stop - 1]
                if size < most and stop < len(sizes):
                    continue
                made = make(texts.slice(start, stop - start))
                own = batch.slice(start, stop - start)
                yield pa.record_batch([*own.columns[:-1], *made], names=names)
                start, size = stop, 0

    out = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in kept), *(T.StructField(a, T.DataType.fromDDL(k), True) for a, k in added)])
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"`{text}`").cast("string").alias(whole)).mapInArrow(run, out)
