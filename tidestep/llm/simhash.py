"""Operator 10: near-duplicates by SimHash, with Golay-code keys for the candidates.

A 64-bit fingerprint has four segments of 16 bits. If two fingerprints differ in at
most three bits, some segment is equal in both and the one after it (the first after the
last) differs in at most one bit: the segments that differ are at most three; if one of
them differs in more than one bit there are at most two, and two or more equal ones, of
which only one can stand before it. Every 23-bit word is within three bits of exactly
one word of the perfect (23, 12, 7) Golay code. The keys of a segment are the indices of
the codewords to which the segment and its one-bit neighbours decode, so of two segments
at most one bit apart the codeword of one is always among the keys of the other. A key
row holds an equal segment (16 bits) and a codeword of the next (12 bits): the index side
takes all keys of that next segment, the probe side its own codeword alone. A join of the
two and a check of the differing bits give all links. Each of the four tables has 2^28
keys, so fingerprints that are not near rarely share one.

Equal fingerprints are one node, so copies are never paired. Keys that many different
fingerprints share are cut into blocks; each pair of blocks is compared in one place and
only a spanning forest of its links leaves it, which keeps the components exact.

Defined results: null, empty and white-space texts have fingerprint zero and are linked
like any other. Texts of any length are read whole. A null doc_id is never the least
of its component unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import process_cache, small_batches, stored, table
from tidestep.llm.components import components

# The Golay code's generator polynomial, and the bits of each of the four segments.
_GENERATOR = 0xC75
_BITS = 16


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one text, unsigned."""
    import xxhash

    parts = text.lower().split()  # of bytes: A-Z, and [\x20\x09-\x0D]
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    ends = stops[min(words, len(parts)) - 1 :]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)], np.uint64)
    by_byte = h.astype("<u8").view(np.uint8).reshape(n, 8)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    out = 0
    for i in range(8):
        counts = np.bincount(by_byte[:, i], minlength=256) @ bits
        out |= int(np.packbits(2 * counts > n, bitorder="little")[0]) << 8 * i
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["key", "fp"])

    small_batches(docs.sparkSession)
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"key {dict(src.dtypes)['key']}, fp long").withColumnRenamed("key", key)


def _syndromes() -> np.ndarray:
    """The remainder of each single bit of a 23-bit word by the generator."""
    out = []
    for bit in range(23):
        v = 1 << bit
        for shift in range(22, 10, -1):
            if v >> shift & 1:
                v ^= _GENERATOR << shift - 11
        out.append(v)
    return np.array(out, np.int64)


def _leaders() -> np.ndarray:
    """The error pattern of at most three bits for each of the 2,048 remainders."""
    cache = process_cache("golay")
    if "leaders" not in cache:
        one, table_ = _syndromes(), np.zeros(2048, np.int64)
        for a in range(23):
            for b in range(a, 23):
                for c in range(b, 23):
                    bits = {a, b, c}  # a repeated bit stands for fewer errors
                    s = 0
                    for x in bits:
                        s ^= int(one[x])
                    table_[s] = sum(1 << x for x in bits)
        cache["leaders"] = table_
    return cache["leaders"]


def codeword(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    s = np.zeros_like(v)
    for bit, one in enumerate(_syndromes()):
        s ^= np.where(v >> bit & 1, one, 0)
    return (v ^ _leaders()[s]) >> 11


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``key``, ``fp`` and ``probe`` (which side of the join) of all key rows of some fingerprints."""
    parts = [((fps.view(np.uint64) >> np.uint64(_BITS * i)) & np.uint64((1 << _BITS) - 1)).astype(np.int64) for i in range(4)]
    out = ([], [], [])
    for i, equal in enumerate(parts):
        after = parts[(i + 1) % 4]
        near = codeword(np.concatenate([after[:, None], after[:, None] ^ (1 << np.arange(_BITS))], axis=1))
        keys = np.sort(near, axis=1)
        fresh = np.ones(keys.shape, bool)
        fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
        row, col = np.nonzero(fresh)
        first = (i << 28) + (equal << 12)
        out[0].extend((first[row] + keys[row, col], first + near[:, 0]))
        out[1].extend((fps[row], fps))
        out[2].extend((np.zeros(len(row), bool), np.ones(len(fps), bool)))
    return tuple(np.concatenate(x) for x in out)


def _forest(a: np.ndarray, b: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between two blocks of fingerprints."""
    near = np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]) <= most
    left, right = np.ones(len(a), bool), np.ones(len(b), bool)
    us, vs = [], []
    for root in range(len(a)):
        if not left[root]:
            continue
        left[root], todo = False, [(True, root)]
        while todo:
            on_left, x = todo.pop()
            new = np.flatnonzero(near[x] & right) if on_left else np.flatnonzero(near[:, x] & left)
            (right if on_left else left)[new] = False
            for y in new.tolist():
                us.append(int(a[x] if on_left else b[x]))
                vs.append(int(b[y] if on_left else a[y]))
                todo.append((not on_left, y))
    return us, vs


def links(nodes: DataFrame, most: int = 3, small: int = 32, block: int = 1024) -> DataFrame:
    """``u``, ``v``: links whose components are those of all pairs of fingerprints (column ``fp``, distinct) at ``most`` (3 or fewer) differing bits.

    Keys of at most ``small`` fingerprints give all their links, larger ones a spanning
    forest for each two blocks of about ``block`` fingerprints.
    """
    if not 0 <= most <= 3:
        raise ValueError("the keys find links of at most three bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            if len(fps):
                yield pa.record_batch([pa.array(x) for x in golay_keys(np.ascontiguousarray(fps))], names=["key", "fp", "probe"])

    rows = stored(nodes.select("fp").mapInArrow(keyed, "key long, fp long, probe boolean"), "golay-keys")
    n_probe, n = F.count_if("probe"), F.count(F.lit(1))
    shared = rows.groupBy("key").agg(n.alias("n"), n_probe.alias("np"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    shared = stored(shared.where("lo < hi AND np > 0 AND np < n").select("key", F.greatest("np", F.col("n") - F.col("np")).alias("n")), "shared-keys")
    live = stored(rows.join(shared, "key"), "live-keys")

    few = live.where(F.col("n") <= small)
    index = few.where("NOT probe").select("key", F.col("fp").alias("u"))
    probe = few.where("probe").select("key", F.col("fp").alias("v"))
    pairs = index.join(probe, "key").where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most))

    cut = live.where(F.col("n") > small).withColumn("part", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / block)))
    blocks = cut.groupBy("key", "part", "probe").agg(F.collect_list("fp").alias("fps"))
    a = blocks.where("NOT probe").select("key", F.col("fps").alias("a"))
    b = blocks.where("probe").select("key", F.col("fps").alias("b"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                us, vs = _forest(x.values.to_numpy(), y.values.to_numpy(), most)
                yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    forest = a.join(b, "key").select("a", "b").mapInArrow(compared, "u long, v long")
    return pairs.select("u", "v").unionByName(forest.where("u <> v"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` (the least ``key`` that links reach) for each row."""
    fps = stored(fingerprints(docs, key, text, words).withColumnRenamed(key, "doc"), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc").alias("doc")), "nodes")
    joined = stored(components(links(nodes, most)), "components")
    members = joined.join(nodes, joined.node == nodes.fp).groupBy("root").agg(F.min("doc").alias("least"))
    of_node = joined.join(members, "root").select("node", "least")
    ids = nodes.join(of_node, nodes.fp == of_node.node, "left").select(F.col("fp").alias("fp2"), F.coalesce("least", "doc").alias("component_id"))
    ids = stored(ids, "component-ids")
    return fps.join(ids, fps.fp == ids.fp2).select(F.col("doc").alias(key), "fp", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract of query 10 over the whole of ``documents``."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
