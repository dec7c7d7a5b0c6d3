"""A corpus pipeline of five stages over ``documents``, each an operator of ``tidestep.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and
returns the rows it keeps with the columns of ``documents``; the last returns what a
trainer reads: ids and digests of the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestep.llm import bpe, decontaminate, langid, line_dedup, simhash
from tidestep.llm.common import stored, table


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named c0, c1, ..., which no operator uses, and the new name of each."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def restored(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in a result over its numbered form."""
    return out.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (operator 7): texts of no language go; a row without a ``lang`` gets the predicted one.

    Of no language are texts that are null or hold no letter; every text is if no row
    names a language to learn. Repeated rows are judged each, long texts whole. A
    ``lang`` that is there stays.
    """
    d, c = numbered(docs)
    model = langid.train(d.where(~langid.held_out(c["doc_id"])), c["doc_id"], c["text"], c["lang"])
    out = langid.identify(d, model, c["text"], names=("language", "sure")).where("language <> 'und'")
    return restored(out.withColumn(c["lang"], F.coalesce(c["lang"], "language")), docs)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (operator 5): lines found in ten documents or more lose all copies; ``n_chars`` follows the text.

    No row goes. A null text stays null; rows of one ``doc_id``, and all with a null
    one, count as one document. Long texts are cut whole.
    """
    d, c = numbered(docs)
    out = line_dedup.apply_bitmaps(d, line_dedup.drop_bitmaps(d, c["doc_id"], c["text"]), c["doc_id"], c["text"])
    if "n_chars" in c:
        out = out.withColumn(c["n_chars"], F.char_length(c["text"]).cast(dict(docs.dtypes)["n_chars"]))
    return restored(out, docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (operator 10): one row of each component stays.

    It is the one with the least ``doc_id``; a null id comes last, and ties go to the
    least hash of the text. Of rows that agree in both, one stays. Null and empty texts
    are one group.
    """
    d, c = numbered(docs)
    key, h = F.col(c["doc_id"]), F.xxhash64(F.coalesce(c["text"], F.lit("")))
    row = F.struct(key.isNull().alias("none"), key.alias("d"), h.alias("h"))
    groups = simhash.near_duplicates(d.select(row.alias("row"), F.col(c["text"]).alias("text")), key="row")
    kept = groups.where(F.col("row").eqNullSafe(F.col("component_id"))).select("row.*").distinct()
    # Keys without nulls: the rows are dealt and sorted once, for the join and for dropping repeated rows.
    zero = F.lit(0).cast(dict(d.dtypes)[c["doc_id"]])
    own = d.withColumns({"none": key.isNull(), "id": F.coalesce(key, zero), "h": h})
    kept = kept.select("none", F.coalesce("d", zero).alias("id"), "h")
    return restored(own.join(kept, ["none", "id", "h"], "left_semi").dropDuplicates(["none", "id", "h"]), docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (operator 9): documents that hold an item of ``benchmark`` go.

    Null and empty texts hold none, and without items no document goes. Rows are judged
    each, so repeated ones agree; long texts are searched whole.
    """
    d, c = numbered(docs)
    model = decontaminate.train(d, table(spark, sf_dir, "benchmark"), c["text"])
    return restored(decontaminate.leaks(d, model, c["text"], name="leaks").where(F.size("leaks") == 0), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding (operator 8): the columns of its query, and ``lang``, for each row.

    A null or empty text has no tokens. Repeated rows are encoded each, long texts whole.
    """
    import public_tokenizers

    d, c = numbered(docs)
    out = bpe.digests(bpe.encode_decode(d, public_tokenizers.path("byte_bpe_50k.json"), c["doc_id"], c["text"], (c["lang"],)), c["doc_id"])
    return out.withColumnsRenamed({c["doc_id"]: "doc_id", c["lang"]: "lang"})


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_common_lines),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("bpe_encoding", encoded),
]

#: SQL can express neither the classifier nor the latent space; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the rows are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
