"""Operator 4: exact top-k by inner product, term at a time.

Rows are packed into blocks, once as candidates and once as queries; each task takes some
blocks of either, pair by pair, and no vector is shuffled for that. Of a pair it takes
tiles, and accumulates the products of the terms (components) that occur on both sides of
the tile into dense scores, ``GROUP`` terms at a time: one matrix product adds the postings
of a group. A query keeps the k best it has met; only scores that reach the least of them
are looked at. A window merges what the tasks have found. So that a task need not begin
with none, all queries meet a few blocks first: the k-th best score there is a lower bound
of the k-th best of all, and what is below it is in no result.

Scores are exact: by Cauchy and Schwarz no partial sum is beyond the product of the two
norms, so a tile whose norms keep it under 2^24 is summed as float32, under 2^53 as
float64, and as int64 above.

Defined results: a vector that is null, or holds a null or non-finite component,
takes no part; neither does a row with a null id. Rows that share an id are rows of
their own: each is a candidate for the others, and each that is a query has results.
Ties go to the smaller id. Vectors of unequal length, empty ones too, are compared as if
padded with zeros. An empty table gives an empty result; extra columns are left out,
whatever their names. Memory is bounded by the two block sizes and ``cells``, the numbers
in a block (a single vector may have more).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestep.llm.common import stored, table

#: Terms added at a time; blocks of candidates in a task.
GROUP, RUN = 256, 64
_LOWEST, _HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: A packed block: its first row number, how many rows are queries, the number, id and mark
#: of each row, and the matrix of their vectors in the smallest integers that hold it.
_PACKED = "no long, asks long, dims int, kind string, row binary, id binary, mark binary, v binary"

#: Row numbers, ids, marks and matrix of some rows.
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _padded(sizes: np.ndarray, values: np.ndarray, cells: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Matrices of at most ``cells`` cells (or of one row), each with the first row and the one after the last."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    todo = [(0, len(sizes))] if len(sizes) else []
    while todo:
        a, b = todo.pop()
        own, dims = sizes[a:b], int(sizes[a:b].max())
        if b - a > 1 and dims * (b - a) > cells:
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
            continue
        if own.min() == dims:
            yield a, b, values[ends[a] : ends[b]].reshape(b - a, dims)
            continue
        out = np.zeros((b - a, dims), values.dtype)
        out[np.arange(dims) < own[:, None]] = values[ends[a] : ends[b]]
        yield a, b, out


def _listed(batches: Iterable[pa.RecordBatch], cells: int, scale: float | None) -> Iterator[Rows]:
    """The rows of batches of ids, vectors and marks, numbered; vectors that are null or hold what is no finite number are left out."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        ids, v, marks = batch.columns
        whole = ~v.is_null().to_numpy(zero_copy_only=False)
        sizes, values = np.where(whole, np.diff(v.offsets.to_numpy()), 0), v.flatten()
        if scale is None:
            good, values = values.is_valid().to_numpy(zero_copy_only=False), values.fill_null(0).to_numpy()
        else:
            values = values.to_numpy(zero_copy_only=False).astype(np.float64)
            good = np.isfinite(values)
        if not good.all():
            whole[np.repeat(np.arange(len(v)), sizes)[~good]] = False
            values = values[np.repeat(whole, sizes)]
        if scale is not None:
            values = np.clip(np.floor(scale * values), _LOWEST, _HIGHEST - 1023).astype(np.int64)
        ids, marks, sizes = (x[whole] for x in (ids.to_numpy(), marks.to_numpy(zero_copy_only=False), sizes))
        for a, b, m in _padded(sizes, values, cells):
            yield number + np.arange(a, b), ids[a:b], marks[a:b], m
        number += len(ids)


def _together(pieces: Iterable[Rows], most: int, cells: int) -> Iterator[Rows]:
    """The rows of ``pieces`` by ``most``, or as many as have ``cells`` cells."""
    held: list[Rows] = []
    n = dims = 0

    def whole() -> Rows:
        m = np.zeros((n, dims), np.int64)
        at = 0
        for x in held:
            m[at : (at := at + len(x[3])), : x[3].shape[1]] = x[3]
        return *(np.concatenate([x[i] for x in held]) for i in range(3)), m

    for piece in pieces:
        at = 0
        while at < len(piece[0]):
            wide = max(dims, piece[3].shape[1])
            take = min(most - n, len(piece[0]) - at, cells // max(1, wide) - n)
            if take <= 0 and n:
                yield whole()
                held, n, dims = [], 0, 0
                continue
            take = max(1, take)
            held.append(tuple(x[at : at + take] for x in piece))
            at, n, dims = at + take, n + take, wide
    if n:
        yield whole()


def _packed(blocks: Iterable[Rows]) -> Iterator[pa.RecordBatch]:
    """Blocks as records, their rows by id."""
    for rows in blocks:
        order = np.argsort(rows[1], kind="stable")
        row, ids, marks, m = (x[order] for x in rows)
        low, high = m.min(initial=0), m.max(initial=0)
        kind = next(t for t in ("int8", "int16", "int32", "int64") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        values = (int(row.min()), int(marks.sum()), m.shape[1], kind, row.tobytes(), ids.tobytes(), marks.tobytes(), m.astype(kind).tobytes())
        yield pa.record_batch([pa.array([x], t) for x, t in zip(values, (pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.binary()] * 4), strict=True)], names=[x.split()[0] for x in _PACKED.split(", ")])


def _unpacked(x: Mapping[str, pa.Scalar]) -> Rows:
    row, ids, marks = (np.frombuffer(x[k].as_buffer(), t) for k, t in (("row", np.int64), ("id", np.int64), ("mark", bool)))
    return row, ids, marks, np.frombuffer(x["v"].as_buffer(), x["kind"].as_py()).reshape(len(ids), x["dims"].as_py())


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Rows]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _unpacked({k: batch.column(k)[i] for k in batch.schema.names})


@dataclass
class _Side:
    """The rows of a block, and of each tile the place, the largest norm and the terms that occur."""

    row: np.ndarray
    id: np.ndarray
    m: np.ndarray
    quick: np.ndarray
    tiles: list[tuple[slice, float, np.ndarray]]

    @classmethod
    def of(cls, rows: Rows, tile: int) -> _Side:
        m = rows[3].copy()
        quick = m.astype(np.float32)
        norms = np.sqrt(np.square(m, dtype=np.float64).sum(axis=1))
        at = [slice(a, min(a + tile, len(m))) for a in range(0, len(m), tile)]
        return cls(rows[0].copy(), rows[1].copy(), m, quick, [(s, float(norms[s].max()), m[s].any(axis=0)) for s in at])


@dataclass
class _Best:
    """The k best candidates of each query so far: scores, ids and row numbers, best first; places without one hold the least score and the row -1.

    ``floor`` is a score for each query that the k best of all reach.
    """

    floor: np.ndarray
    score: np.ndarray
    id: np.ndarray
    row: np.ndarray

    @classmethod
    def none(cls, floor: np.ndarray, k: int) -> _Best:
        n = len(floor)
        return cls(floor, np.full((n, k), _LOWEST), np.full((n, k), _HIGHEST), np.full((n, k), -1))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        k = self.score.shape[1]
        own = np.unique(query)
        query = np.concatenate([np.repeat(own, k), query])
        new = [np.concatenate([was[own].ravel(), x]) for was, x in ((self.score, score), (self.id, ids), (self.row, row))]
        order = np.lexsort((new[2], new[1], ~new[0], query))
        pick = order[np.searchsorted(query[order], own)[:, None] + np.arange(k)]
        self.score[own], self.id[own], self.row[own] = (x[pick] for x in new)


def _accumulated(q: _Side, q_tile: tuple, c: _Side, c_tile: tuple, room: np.ndarray) -> np.ndarray:
    """The scores of a tile, candidates by queries, in ``room`` if they fit float32."""
    (at, q_norm, q_terms), (to, c_norm, c_terms) = q_tile, c_tile
    width, most = min(len(q_terms), len(c_terms)), q_norm * c_norm * (1 + 1e-9)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    left, right = (c.quick, q.quick) if kind is np.float32 else (c.m, q.m)
    left, right, both = left[to, :width], right[at, :width], q_terms[:width] & c_terms[:width]
    if not both.all():
        left, right = left[:, both], right[:, both]
    left, right = left.astype(kind, copy=False), right.astype(kind, copy=False)
    scores = room[: len(left) * len(right)].reshape(len(left), len(right)) if kind is np.float32 else np.empty((len(left), len(right)), kind)
    np.matmul(left[:, :GROUP], right[:, :GROUP].T, out=scores)
    for t in range(GROUP, left.shape[1], GROUP):
        scores += left[:, t : t + GROUP] @ right[:, t : t + GROUP].T
    return scores


def _sure(scores: np.ndarray, k: int, parts: int = 64) -> np.ndarray:
    """For each query a score that k of its other candidates reach, whichever one of them is the query itself."""
    if k + 1 > parts or len(scores) < parts:
        return np.full(scores.shape[1], _LOWEST)
    most = scores[: len(scores) // parts * parts].reshape(-1, parts, scores.shape[1]).max(axis=0)
    return np.partition(most, parts - k - 1, axis=0)[parts - k - 1].astype(np.int64)


def _least(score: np.ndarray, late: np.ndarray, floor: np.ndarray, kind: np.dtype) -> np.ndarray:
    """What a candidate must reach to be among the best whose last one has ``score``: more than that, if it comes too late for a tie."""
    least = np.maximum(score + (late & (score < _HIGHEST)), floor)
    if kind != np.int64:
        limit = (1 << (24 if kind == np.float32 else 53)) + 2
        least = np.minimum(np.maximum(least, -limit), limit).astype(kind)
    return least


def _meet(q: _Side, best: _Best, c: _Side, room: np.ndarray) -> None:
    """Adds a block of candidates to what the queries have found."""
    k = best.score.shape[1]
    for q_tile in q.tiles:
        at = q_tile[0]
        own, floor = q.row[at], best.floor[at]
        found: list[tuple] = []
        held = -1
        for c_tile in c.tiles:
            to = c_tile[0]
            if held < 0:
                score, last, held = best.score[at, -1].copy(), best.id[at, -1].copy(), 0
                new = np.maximum(score, floor).min() == _LOWEST
            scores = _accumulated(q, q_tile, c, c_tile, room)
            least = _least(score, last < c.id[to.start], floor, scores.dtype)
            if new:
                least = np.maximum(least, _sure(scores, k).astype(least.dtype))
            hit = np.flatnonzero(scores.max(axis=0) >= least)
            if not len(hit):
                continue
            if 8 * len(hit) > len(own):
                hit, some = np.arange(len(own)), scores
            else:
                some = np.take(scores, hit, axis=1)
            place = np.flatnonzero(some >= least[hit])
            j, i = np.divmod(place, len(hit))
            other = own[hit[i]] != c.row[to][j]
            i, j, place = hit[i[other]], j[other], place[other]
            found.append((at.start + i, some.ravel()[place].astype(np.int64), c.id[to][j], c.row[to][j]))
            held += len(i)
            if held >= 4 * len(own):
                best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
                found, held = [], -1
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _met(batches: Iterable[pa.RecordBatch], k: int, tile: int) -> Iterable[tuple[_Side, _Best]]:
    """The query blocks of batches of pairs (candidates, queries), with what each has found in all it met."""
    asked: dict[int, tuple[_Side, _Best]] = {}
    room, c, of = np.empty(tile * tile, np.float32), None, -1
    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1), strict=True):
            if (no := x["no"].as_py()) != of:
                c, of = _Side.of(_unpacked(x), tile), no
            if (no := y["no"].as_py()) not in asked:
                q = _Side.of(_unpacked(y), tile)
                floor = np.frombuffer(y["floor"].as_buffer(), np.int64).copy() if "floor" in y else np.full(len(q.id), _LOWEST)
                asked[no] = q, _Best.none(floor, k)
            _meet(*asked[no], c, room)
    return asked.values()


def topk_inner(
    vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "v", block: int = 8192, query_block: int = 8192,
    tile: int = 768, cells: int = 1 << 22, scale: float | None = None,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k best other rows for each row where ``is_query`` holds.

    ``vector`` is an array<long>; with a ``scale``, an array of floats or doubles, each of
    which counts as floor(scale * x). Ties go to the smaller id.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id IS NOT NULL")
    n, n_q = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(_together(_listed(batches, cells, scale), block, cells))

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(tuple(x[rows[2]] for x in rows) for rows in _blocks(batches))

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(_together(_blocks(batches), query_block, cells))

    candidates = stored(rows.coalesce(max(1, math.ceil(n / block))).mapInArrow(pack, _PACKED), "candidates")
    queries = candidates.where("asks > 0").mapInArrow(asking, _PACKED).repartition(max(1, math.ceil(n_q / query_block)))
    queries = stored(queries.mapInArrow(regroup, _PACKED), "queries")

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, best in _met(batches, k, tile):
            for record in _packed([(q.row, q.id, np.ones(len(q.id), bool), q.m)]):
                yield record.append_column("floor", pa.array([best.score[:, -1].tobytes()], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, best in _met(batches, k, tile):
            i, j = np.nonzero(best.row >= 0)
            yield pa.record_batch([q.row[i], q.id[i], best.row[i, j], best.id[i, j], best.score[i, j]], names=["query_row", "query_id", "row", "vec_id", "score"])

    def pairs(c: DataFrame, q: DataFrame) -> DataFrame:
        return c.select(F.struct("*").alias("c")).join(q.select(F.struct("*").alias("q")).hint("shuffle_replicate_nl"))

    places = sorted(x.no for x in candidates.select("no").collect())
    first = places[:: max(1, math.ceil(len(places) / (math.isqrt(len(places)) // 2 + 1)))]
    asked = stored(pairs(candidates.where(F.col("no").isin(first)).coalesce(1), queries).mapInArrow(seed, f"{_PACKED}, floor binary"), "asked")
    # A query has k rows from each task that met it, so the tasks are few and have many candidates.
    met = pairs(candidates.coalesce(max(32, math.ceil(n / (RUN * block)))), asked)
    scored = met.mapInArrow(run, "query_row long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """Contract of query 4 over the whole of ``embeddings``."""
    return topk_inner(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, vector="embedding", scale=256.0)


OP4_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (
  SELECT q.nth AS nth, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.nth <> c.nth
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
