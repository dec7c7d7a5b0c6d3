"""Operator 5 [native]: lines that many documents share.

Each line becomes two 64-bit hashes of its key. The hashes are range-partitioned by
(hash, document) with a secondary sort by position, so a very common line is spread
over many partitions and each partition streams the first occurrence of a line in a
document. Counting what is left gives the frequent keys. The operator returns no
text but, for each document, the words of a bitmap that have a dropped line.

Defined results: a null or empty text is one empty line, and an empty key is never
dropped. Rows are told apart by doc_id and text; repeated rows of one doc_id count
as one document, and so do all rows with a null doc_id. An empty table gives an empty
result. Extra columns pass through whatever their names. Two different keys count as
one only if both hashes agree (128 bits).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import SPACE, ascii_lower, fresh, stored, table

_ROW = ["doc_id", "_text_hash"]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    src = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    return src.select("doc_id", F.xxhash64("_text").alias("_text_hash"), "_text")


def line_hashes(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 1) -> DataFrame:
    """One row for each line whose key has ``min_chars`` code points: its document, position and two hashes."""
    lines = _rows(docs, key, text).select(*_ROW, F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select(*_ROW, "pos", ascii_lower(F.btrim("line", F.lit(SPACE))).alias("k"))
    return keyed.where(F.char_length("k") >= min_chars).select(
        *_ROW, "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), F.col("k")).alias("h2")
    )


def drop_bitmaps(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False
) -> DataFrame:
    """``doc_id``, ``_text_hash`` and ``dropped``: map of 64-line word number to the bits of its dropped lines.

    Only documents that lose a line have a row. With ``keep_first`` the earliest
    occurrence (by doc_id, then position) of a frequent line stays.
    """
    hashes = stored(line_hashes(docs, key, text, min_chars), "line-hashes")
    ranged = hashes.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    firsts = ranged.groupBy("h1", "h2", "doc_id").agg(F.min("pos").alias("pos"))  # no further exchange
    frequent = (
        firsts.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "first")
    )
    gone = hashes.join(stored(frequent, "frequent-lines"), ["h1", "h2"])
    if keep_first:
        gone = gone.where(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
    words = gone.groupBy(*_ROW, F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits")
    )
    return words.groupBy(*_ROW).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``text`` cut to the kept lines, and then ``_n_lines``, ``_n_dropped``.

    If ``docs`` has columns of these two names, those stay and the added ones get an underscore behind.
    """
    n_lines, n_dropped, k, h, own, dropped = fresh(docs.columns, "_n_lines", "_n_dropped", "_k", "_h", "_own_hash", "_dropped")
    b = bitmaps.select(F.col("doc_id").alias(k), F.col("_text_hash").alias(h), F.col("dropped").alias(dropped))
    d = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    out = d.join(b, F.col(key).eqNullSafe(F.col(k)) & (F.col(own) == F.col(h)), "left")
    lines = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", -1)
    bits = lambda i: F.coalesce(F.try_element_at(F.col(dropped), F.shiftright(i, 6)), F.lit(0).cast("long"))
    is_kept = lambda _, i: F.call_function("getbit", bits(i), i.bitwiseAND(F.lit(63))) == 0
    kept = F.array_join(F.filter(lines, is_kept), "\n")
    n_gone = F.coalesce(F.aggregate(F.map_values(dropped), F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x)), F.lit(0).cast("long"))
    return (
        out.withColumns({n_lines: F.size(lines).cast("long"), n_dropped: n_gone})
        .withColumn(text, F.when(F.col(dropped).isNull(), F.col(text)).otherwise(kept))
        .select(*(f"`{c}`" for c in docs.columns), n_lines, n_dropped)
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract of query 5 over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, drop_bitmaps(docs))
    return out.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP5_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY k.doc_id
"""
