"""Operator 3: repeated lines, paragraphs or passages, by hashing.

Each unit (line, paragraph, or sentence of a line) is normalised: A-Z lower-cased, white space trimmed and
its runs made one space. Units of at least ``min_words`` words are grouped by a 128-bit
digest over all documents; the earliest ranked occurrence (``rank``, then the key, then
position) stays and all others are removed. Removed units keep their offsets in the
original text.

``passages`` looks at runs of adjacent units that all occur elsewhere too: only a run of
``min_words`` words or more is a repeated passage. So a long passage is found wherever in
a line it stands and however short its lines are, and common short lines are left alone.

Defined results: a null or empty text is one empty unit; units that are too short
always stay. An empty table gives an empty result. Ties in rank go to the smaller key,
then the earlier position. Extra columns pass through whatever their names; added names
that are there already get an underscore behind. Texts of any length are read whole.
Rows are told apart by key and text, so rows that repeat as a whole are
one document and agree in what they lose. A null key ranks first. The count of a unit
has a partial step and the join that hands it back can be split, so one unit may hold
any share of the rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import SPACE, ascii_lower, fresh, stored, table, with_text_columns

SEPARATORS = {"line": "\n", "paragraph": "\n\n"}


def _normal(unit: Column) -> Column:
    """The unit with A-Z lower-cased, trimmed, and each run of white space as one space."""
    return F.btrim(F.regexp_replace(ascii_lower(unit), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))


def _units(body: Column, unit: str) -> Column:
    """The units of a text. Of sentences and lines, each ends one character before the next begins."""
    if unit == "sentence":
        for end in ".!?":
            body = F.replace(body, F.lit(f"{end} "), F.lit(f"{end}\n"))
    return F.split(body, SEPARATORS.get(unit, "\n"), -1)


def unit_digests(docs: DataFrame, key: str, text: str, unit: str, min_words: int, rank: str | None) -> DataFrame:
    """``k``, ``h`` (of the text), ``r`` (rank), ``pos``, ``w`` (words) and the digest ``h1``, ``h2`` of each unit that is long enough."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), (F.col(rank) if rank else F.lit(0)).alias("r"), F.xxhash64(body).alias("h"), body.alias("t"))
    units = rows.select("k", "r", "h", F.posexplode(_units(F.col("t"), unit)).alias("pos", "u"))
    normal = units.select("k", "r", "h", "pos", _normal(F.col("u")).alias("u"))
    words = F.char_length("u") - F.char_length(F.replace(F.col("u"), F.lit(" "), F.lit(""))) + 1
    long_enough = normal.where((F.col("u") != "") & (words >= min_words))
    return long_enough.select("k", "r", "h", "pos", words.alias("w"), F.xxhash64("u").alias("h1"), F.xxhash64(F.lit("second"), F.col("u")).alias("h2"))


def removed_positions(docs: DataFrame, key: str, text: str, unit: str, min_words: int, rank: str | None) -> DataFrame:
    """``k``, ``h`` and ``gone`` (sorted positions of removed units) for each document that loses one."""
    rows = stored(unit_digests(docs, key, text, unit, min_words, rank), "unit-digests")
    place = F.struct("r", "k", "pos")
    firsts = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first")
    later = rows.join(stored(firsts, "first-units"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("k", "h").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", min_words: int = 8, rank: str | None = None) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, and ``_n_units`` long, ``_removed`` array of (start, stop) character offsets in the original text."""
    sep = SEPARATORS[unit]
    gone = removed_positions(docs, key, text, unit, min_words, rank)
    both = _with_notes(docs, key, text, gone.select("k", "h", F.concat_ws(",", F.col("gone").cast("array<string>")).alias("note")))

    def cut(texts: pa.Array) -> list[pa.Array]:
        kept, removed, counts = [], [], []
        for t in texts.to_pylist():
            positions, _, body = t.partition("\n")
            parts, spans = body.split(sep), []
            counts.append(len(parts))
            drop = {*map(int, positions.split(","))} if positions else ()
            if not drop:
                kept.append(body)
                removed.append(spans)
                continue
            at, left = 0, []
            for i, p in enumerate(parts):
                if i in drop:
                    spans.append({"start": at, "stop": at + len(p)})
                else:
                    left.append(p)
                at += len(p) + len(sep)
            kept.append(sep.join(left))
            removed.append(spans)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return [pa.array(kept, pa.string()), pa.array(removed, kind), pa.array(counts, pa.int64())]

    made = [("_kept", "string"), ("_removed", "array<struct<start:bigint,stop:bigint>>"), ("_n_units", "bigint")]
    return _with_kept(docs, text, with_text_columns(both, both.columns[-1], cut, made))


def _with_notes(docs: DataFrame, key: str, text: str, notes: DataFrame) -> DataFrame:
    """``docs`` and a last column with the row's ``note`` (empty if it has none), a new line and the text. ``notes`` has ``k``, ``h`` (of the text), ``note``."""
    own, k, h, note, both = fresh(docs.columns, "own_hash", "k", "h", "note", "both")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    joined = docs.withColumn(own, F.xxhash64(body)).join(notes.toDF(k, h, note), F.col(f"`{key}`").eqNullSafe(F.col(k)) & (F.col(own) == F.col(h)), "left")
    return joined.select(*(f"`{c}`" for c in docs.columns), F.concat(F.coalesce(note, F.lit("")), F.lit("\n"), body).alias(both))


def _with_kept(docs: DataFrame, text: str, done: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the kept text in place of ``text``, then the other added columns; ``done`` has ``docs``, the read column, the kept text and those."""
    n = len(docs.columns)
    kept, *added = done.columns[n + 1 :]
    return done.select(*(F.col(f"`{kept}`").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns), *added)


def repeated_units(docs: DataFrame, key: str, text: str, unit: str, rank: str | None) -> DataFrame:
    """``k``, ``h`` and ``note`` for each document with a unit that occurs elsewhere: "position words later" of each such unit, by position.

    ``later`` is 0 for the earliest occurrence and 1 for the others.
    """
    rows = stored(unit_digests(docs, key, text, unit, 1, rank), "unit-digests")
    place = F.struct("r", "k", "pos")
    places = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    hits = rows.join(stored(places.select("h1", "h2", "first"), "repeated-units"), ["h1", "h2"])
    hits = hits.select("k", "h", F.struct("pos", "w", (~place.eqNullSafe(F.col("first"))).cast("int").alias("later")).alias("u"))
    units = hits.groupBy("k", "h").agg(F.array_sort(F.collect_set("u")).alias("us"))
    return units.select("k", "h", F.array_join(F.transform("us", lambda u: F.concat_ws(" ", u["pos"], u["w"], u["later"])), ",").alias("note"))


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "sentence", min_words: int = 30, rank: str | None = None) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, then ``_removed``, ``_n_units`` and ``_n_repeated``.

    A run of adjacent units (those without a word between them do not part them) that each
    occur elsewhere is a passage if it has ``min_words`` words. Of the units of passages
    (``_n_repeated`` of them in the row) the earliest occurrences stay; the others go with
    the separator behind them, and ``_removed`` has their (start, stop) character offsets
    in the original text.
    """
    if unit not in ("sentence", "line"):
        raise ValueError("units are sentences or lines")
    both = _with_notes(docs, key, text, repeated_units(docs, key, text, unit, rank))

    def cut(texts: pa.Array) -> list[pa.Array]:
        kept, removed, counts, repeated = [], [], [], []
        for t in texts.to_pylist():
            note, _, body = t.partition("\n")
            even = body.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n") if unit == "sentence" else body
            units = even.split("\n")
            spans, n = [], 0
            if note:
                of = {int(p): (int(w), later == "1") for p, w, later in (x.split(" ") for x in note.split(","))}
                runs, run = [], []
                for p, u in enumerate(units):
                    if p in of:
                        run.append(p)
                    elif u.strip(SPACE):
                        runs.append(run)
                        run = []
                gone = set()
                for run in [*runs, run]:
                    if sum(of[p][0] for p in run) >= min_words:
                        n += len(run)
                        gone.update(p for p in run if of[p][1])
                at = 0
                for p, u in enumerate(units):
                    stop = min(at + len(u) + 1, len(body))
                    if p in gone:
                        spans.append({"start": at, "stop": stop})
                    at = stop
            edges = [0, *(e for s in spans for e in (s["start"], s["stop"])), len(body)]
            kept.append("".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            removed.append(spans)
            counts.append(len(units))
            repeated.append(n)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return [pa.array(kept, pa.string()), pa.array(removed, kind), pa.array(counts, pa.int64()), pa.array(repeated, pa.int64())]

    made = [("_kept", "string"), ("_removed", "array<struct<start:bigint,stop:bigint>>"), ("_n_units", "bigint"), ("_n_repeated", "bigint")]
    return _with_kept(docs, text, with_text_columns(both, both.columns[-1], cut, made))


def _losses(out: DataFrame, *more) -> DataFrame:
    spans = F.transform("_removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string")))
    return out.select(
        "doc_id",
        *more,
        F.size("_removed").cast("long").alias("n_removed"),
        F.col("_n_units").alias("n_units"),
        F.array_join(spans, ",").alias("removed_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op3_passages(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of 30 words or more, by sentences, over the whole of ``documents``: which documents hold one, and what each loses."""
    out = passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _losses(out.withColumn("has_repeat", F.col("_n_repeated") > 0), "has_repeat", F.col("_n_repeated").alias("n_repeated"))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated lines of eight words or more over the whole of ``documents``: what each document loses, with offsets."""
    return _losses(dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_all_lines(spark, sf_dir: str) -> DataFrame:
    """As ``op3_substring_dedup``, for repeated lines of any number of words."""
    return _losses(dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS key,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM l),
r AS (
  SELECT *, key <> '' AND len(string_split(key, ' ')) >= 8
            AND row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1 AS gone
  FROM k)
SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(line) AS BIGINT), ',' ORDER BY pos) FILTER (WHERE gone), '') AS removed_spans,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""

OP3_ALL_SQL = OP3_SQL.replace("len(string_split(key, ' ')) >= 8", "len(string_split(key, ' ')) >= 1")

OP3_PASSAGES_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body,
         string_split(replace(replace(replace(coalesce(text, ''), '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10)), chr(10)) AS units
  FROM documents),
u AS (SELECT doc_id, body, unnest(units) AS unit, generate_subscripts(units, 1) AS pos FROM d),
s AS (
  SELECT *, coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS key
  FROM u),
k AS (SELECT doc_id, pos, key, start, least(start + length(unit) + 1, length(body)) AS stop, substr(body, CAST(start AS BIGINT) + 1, length(unit) + 1) AS part FROM s),
r AS (
  SELECT *, len(string_split(key, ' ')) AS w, count(*) OVER (PARTITION BY key) > 1 AS rep,
         row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1 AS later,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth
  FROM k WHERE key <> ''),
g AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM r WHERE rep),
p AS (SELECT doc_id, pos, later FROM (SELECT *, sum(w) OVER (PARTITION BY doc_id, run) AS words FROM g) WHERE words >= 30)
SELECT k.doc_id AS doc_id, count(p.pos) > 0 AS has_repeat, count(p.pos) AS n_repeated, count(*) FILTER (WHERE p.later) AS n_removed, count(*) AS n_units,
       coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY k.pos) FILTER (WHERE p.later), '') AS removed_spans,
       sha256(coalesce(string_agg(part, '' ORDER BY k.pos) FILTER (WHERE p.later IS NOT TRUE), '')) AS kept_sha256
FROM k LEFT JOIN p ON p.doc_id = k.doc_id AND p.pos = k.pos
GROUP BY k.doc_id
"""
