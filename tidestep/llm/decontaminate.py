"""Operator 9: benchmark items that leaked into documents, by latent semantic retrieval.

Terms are the words of the benchmark (the stated query set). Documents are cut into
blocks of 32 words, and TF-IDF weights come from the document frequency over all
blocks of all documents. A randomised SVD of the blocks is distributed: each task
multiplies its rows with a random sketch and back, the products are summed by parts of
the vocabulary, and the small factor is solved on the driver (vocabulary times rank
numbers, whatever the size of the corpus). Every pair of adjacent blocks is a passage;
its cosine to each item in the latent space gives the candidates. A space of a bounded rank
has no place for the rarest words, so passages that hold enough words of an item to be a
leak whatever their order are candidates as well (``verbatim``). Candidates are verified by
the longest common subsequence of content words, so paraphrases with changed or
inserted words are found, and by the answer: the last sentence of the item, found word
by word (its content words, or all if it has none). Both look at the passage and the
block on either side of it, so that long pieces are seen whole.

Defined results: null and empty texts leak nothing, nor do items without a word. Items
of the same words are matched each, so there are no ties. Empty tables give no leaks. A
null id is an id like any other; extra columns pass through whatever their names. Texts are read whole; words are runs of letters and
digits (other than ASCII: any character), A-Z lower-cased. Rows are not shuffled, so
repeated rows and very long texts need no special case.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import process_cache, table, with_text_columns

BLOCK = 32
_STEP = 1 << 20


def _tables() -> dict:
    """Tables of the word hash: a number for each byte, which bytes are of words, powers and their inverses."""
    t = process_cache("word-hash")
    if not t:
        r = np.random.default_rng(20)
        value = r.integers(1, 1 << 63, 256, dtype=np.uint64)
        value[65:91] = value[97:123]
        word = np.zeros(256, bool)
        word[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
        base = 0x9E3779B97F4A7C15

        def powers(b: int) -> np.ndarray:
            out = np.full(2 * _STEP, b, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        t |= {"value": value, "word": word, "up": powers(base), "down": powers(pow(base, -1, 1 << 64))}
    return t


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of some bytes, and where it starts. No word crosses a bound."""
    t = _tables()
    if len(raw) > _STEP + _STEP // 2:  # cut a very long text between words
        at = _STEP
        while at < len(raw) and t["word"][raw[at]] and at - _STEP < _STEP // 4:
            at += 1
        h, s = words(raw[:at], bounds[bounds < at])
        h2, s2 = words(raw[at:], bounds[bounds >= at] - at)
        return np.concatenate((h, h2)), np.concatenate((s, s2 + at))
    inside = t["word"][raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = bounds[(bounds > 0) & (bounds < len(raw))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(t["value"][raw] * t["up"][: len(raw)], out=sums[1:])
    return (sums[b] - sums[a]) * t["down"][a], a


def _lookup(vocabulary: np.ndarray):
    """A function from hashes to their index in a sorted vocabulary, or -1."""
    bits = max(8, int(vocabulary.size).bit_length() + 4)
    shift = np.uint64(64 - bits)
    starts = np.searchsorted(vocabulary >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
    longest = int(np.diff(starts).max(initial=0))
    padded = np.concatenate((vocabulary, np.zeros(longest + 1, np.uint64)))

    def find(h: np.ndarray) -> np.ndarray:
        at = starts[h >> shift]
        out = np.full(len(h), -1, np.int32)
        for k in range(longest):
            out = np.where(padded[at + k] == h, at + k, out)
        return np.where(out < len(vocabulary), out, -1)

    return find


@dataclass
class Blocks:
    """Tokens of some texts that are in the vocabulary, in order: term and block; the text of each block; all words' hashes."""

    term: np.ndarray
    block: np.ndarray
    text_of: np.ndarray


def _blocks(texts: pa.Array, find) -> Blocks:
    """The blocks of some texts; each text begins a new block."""
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    bounds = off[:-1] - off[0]
    h, starts = words(raw, bounds)
    own = np.searchsorted(bounds, starts, "right") - 1
    n = np.bincount(own, minlength=len(texts))
    before = np.cumsum(n) - n
    nth = np.arange(len(h)) - before[own]
    n_blocks = -(-n // BLOCK)
    first = np.cumsum(n_blocks) - n_blocks
    term = find(h)
    live = np.flatnonzero(term >= 0)
    return Blocks(term[live], (first[own] + nth // BLOCK)[live], np.repeat(np.arange(len(texts)), n_blocks))


def _by_group(group: np.ndarray, row: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` groups, the sum of its rows of ``weights``."""
    out = np.empty((n, weights.shape[1]), np.float32)
    for k, column in enumerate(np.ascontiguousarray(weights.T)):
        out[:, k] = np.bincount(group, column[row], n)
    return out


@dataclass
class LeakModel:
    """Benchmark pieces with their terms, and the latent space."""

    vocabulary: np.ndarray  # sorted hashes
    content: np.ndarray  # which terms count
    pieces: list[np.ndarray]  # content terms of each piece, in order
    answers: list[np.ndarray]  # content terms of the last sentence of each piece's item; all its terms if none is content
    item: list[int]  # number of each piece's item
    items: list  # ids
    latent: np.ndarray | None = None  # (terms, rank), weighted by inverse document frequency
    targets: np.ndarray | None = None  # unit latent vectors of the pieces

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """For each term, where its pieces begin in the second array, which has the pieces."""
        pairs = np.unique(np.concatenate([p.astype(np.int64) * len(self.pieces) + i for i, p in enumerate(self.pieces)]))
        terms = pairs // len(self.pieces)
        return np.searchsorted(terms, np.arange(len(self.vocabulary) + 1)), pairs % len(self.pieces)


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.zeros(1, np.int64))[0] if len(raw) else np.zeros(0, np.uint64)


def _term_counts(docs: DataFrame, text: str, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """Of all blocks of all documents, how many hold each term; the number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = _lookup(vocabulary), np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for texts in _slices(batch.column(0)):
                b = _blocks(texts, find)
                counts[:-1] += np.bincount(np.unique(b.block * len(vocabulary) + b.term) % len(vocabulary), minlength=len(vocabulary))
                counts[-1] += len(b.text_of)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(counts[used])], names=["term", "n"])

    got = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each term of the benchmark
    counts = np.zeros(len(vocabulary) + 1, np.int64)
    for r in got:
        counts[r.term] = r.n
    return counts[:-1], int(counts[-1])


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of about 4 MB."""
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _STEP, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def _sketch(docs: DataFrame, text: str, vocabulary: np.ndarray, idf: np.ndarray, width: int, parts: int = 16) -> np.ndarray:
    """A'AS for the TF-IDF matrix A of all blocks and a random matrix S of ``width`` columns."""
    scaled = _random(len(idf), width) * idf[:, None]
    per = -(-len(idf) // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, out = _lookup(vocabulary), np.zeros((per * parts, width), np.float32)
        for batch in batches:
            for texts in _slices(batch.column(0)):
                b = _blocks(texts, find)
                use = idf[b.term] > 0
                term, block = b.term[use], b.block[use]
                if not len(term):
                    continue
                y = _by_group(block, term, scaled, len(b.text_of))
                out[: len(idf)] += _by_group(term, block, y, len(idf)) * idf[:, None]
        blobs = [x.tobytes() for x in out.reshape(parts, per, width)]
        yield pa.record_batch([pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "z"])

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros(per * width)
        for batch in batches:
            for x in batch.column("z"):
                z += np.frombuffer(x.as_buffer(), np.float32)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([z.tobytes()], pa.binary())], names=["part", "z"])

    made = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "part int, z binary")
    got = {r.part: np.frombuffer(bytes(r.z), float) for r in made.groupBy("part").applyInArrow(total, "part int, z binary").collect()}  # terms of the benchmark times rank
    z = np.concatenate([got.get(p, np.zeros(per * width)) for p in range(parts)]).reshape(-1, width)
    return z[: len(idf)]


def _random(n: int, width: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((n, width)).astype(np.float32)


def randomised_svd(z: np.ndarray, s: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of A from Z = A'AS (single pass, Nystroem form)."""
    c = s.T.astype(float) @ z
    val, vec = np.linalg.eigh((c + c.T) / 2)
    keep = val > max(val.max(initial=0), 0) * 1e-10
    if not keep.any():
        return np.zeros((len(z), 0))
    half = z @ (vec[:, keep] / np.sqrt(val[keep]))
    v, sv, _ = np.linalg.svd(half, full_matrices=False)
    return v[:, : min(rank, int((sv > 1e-9).sum()))]


def train(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", rank: int = 128, max_share: float = 0.01, piece: int = 48) -> LeakModel:
    """Statistics of the whole corpus and its latent space for the items of ``benchmark``.

    Terms in more than ``max_share`` of all blocks are stop words, except for the rarest
    terms of items that have little else. Items of more than ``piece`` words are searched in equal parts.
    """
    rows = sorted(((r.i, r.t) for r in benchmark.select(F.col(item_key).alias("i"), F.col(item_text).cast("string").alias("t")).where("t IS NOT NULL").distinct().collect()), key=str)
    hashed = [(i, _hashes(t), _hashes(([x for x in re.split(r"(?<=[.!?])\s+|\n+", t.strip()) if re.search(r"\w", x)] or [""])[-1])) for i, t in rows]
    hashed = [x for x in hashed if len(x[1])]
    vocabulary = np.unique(np.concatenate([h for _, h, _ in hashed])) if hashed else np.zeros(0, np.uint64)
    m = LeakModel(vocabulary, np.zeros(len(vocabulary), bool), [], [], [], [i for i, _, _ in hashed])
    if not hashed:
        return m
    counts, n = _term_counts(docs, text, vocabulary)
    m.content = counts <= max_share * n
    of = [np.searchsorted(vocabulary, h) for _, h, _ in hashed]
    for terms in of:  # little else: less than four terms that count, or a third of the words
        enough = int(max(4, len(terms) / 3))
        if m.content[terms].sum() < enough:
            m.content[terms[np.argsort(counts[terms], kind="stable")[:enough]]] = True  # the rarest
    idf = np.where(m.content, np.log((n + 1) / (counts + 1)) + 1, 0).astype(np.float32)
    for k, terms in enumerate(of):
        answer = np.searchsorted(vocabulary, hashed[k][2])
        for part in np.array_split(terms, math.ceil(len(terms) / piece)):
            m.pieces.append(part[m.content[part]])
            m.answers.append(answer[m.content[answer]] if m.content[answer].any() else answer)
            m.item.append(k)
    width = min(rank + 8, len(vocabulary))
    v = randomised_svd(_sketch(docs, text, vocabulary, idf, width), _random(len(idf), width), rank)
    if not v.shape[1]:  # no document has a term: any basis finds the same nothing
        v = np.eye(len(vocabulary), min(rank, len(vocabulary)))
    m.latent = (v * idf[:, None]).astype(np.float32)
    targets = np.stack([m.latent[p].sum(0) for p in m.pieces])
    m.targets = (targets / np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return m


def common_subsequence(a: list[int], b: np.ndarray) -> int:
    """Length of the longest common subsequence, a word of bits for the whole of ``a``."""
    at: dict[int, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full = v = (1 << len(a)) - 1
    for x in b:
        u = v & at.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _contains(part: np.ndarray, whole: np.ndarray) -> bool:
    """Whether one sequence is a contiguous part of another."""
    n = len(part)
    if not n or n > len(whole):
        return False
    return any(np.array_equal(whole[k : k + n], part) for k in np.flatnonzero(whole[: len(whole) - n + 1] == part[0]))


def find_leaks(m: LeakModel, texts: pa.Array, find, least_cosine: float, least_common: float, least_with_answer: float, verbatim: bool = True) -> list[dict]:
    """For each text, item number to (common share, cosine, answer found) of what is verified."""
    out: list[dict] = [{} for _ in range(len(texts))]
    b = _blocks(texts, find)
    use = m.content[b.term]
    term, block = b.term[use], b.block[use]
    n = len(b.text_of)
    if not len(term):
        return out
    begin_all = np.searchsorted(b.block, np.arange(n + 1))
    # Blocks of the text around the passage that begins at each block: one before it, one after it.
    low = np.maximum(np.arange(n) - 1, np.searchsorted(b.text_of, b.text_of))
    high = np.minimum(np.arange(n) + 3, np.searchsorted(b.text_of, b.text_of, "right"))
    half = _by_group(block, term, m.latent, n)
    whole = half.copy()
    same = b.text_of[1:] == b.text_of[:-1]
    whole[:-1][same] += half[1:][same]
    sizes = np.linalg.norm(whole, axis=1)
    begin = np.searchsorted(block, np.arange(n + 2))
    lens = np.array([len(p) for p in m.pieces])
    count, at_piece = m.postings()
    rows = max(64, (1 << 22) // len(lens))
    for at in range(0, n, rows):
        stop = min(n, at + rows)
        # Words of each piece in each block, with those around the first and the last passage.
        left, right = low[at], high[stop - 1]
        a, b_ = begin[left], begin[right]
        per = count[term[a:b_] + 1] - count[term[a:b_]]
        own = np.repeat(block[a:b_] - left, per)
        first = np.cumsum(per) - per
        piece = at_piece[np.arange(len(own)) - np.repeat(first, per) + np.repeat(count[term[a:b_]], per)]
        held = np.bincount(own * len(lens) + piece, minlength=(right - left) * len(lens)).reshape(-1, len(lens))
        shared = np.zeros((stop - at, len(lens)), held.dtype)
        for k in range(4):
            block_of = low[at:stop] + k
            inside = block_of < high[at:stop]
            shared[inside] += held[block_of[inside] - left]
        cosine = (whole[at:stop] / np.maximum(sizes[at:stop, None], 1e-12)) @ m.targets.T
        candidate = cosine >= least_cosine
        if verbatim:
            candidate |= shared >= least_common * lens
        # Of candidates, those with too few words of the piece around them can't reach the common share.
        row, col = np.nonzero(candidate & (shared >= np.maximum(1, least_with_answer * lens)))
        for i, p in zip(row.tolist(), col.tolist(), strict=True):
            k = at + i
            passage = term[begin[low[k]] : begin[high[k]]]
            share = common_subsequence(m.pieces[p].tolist(), passage.tolist()) / lens[p]
            if share < least_with_answer:
                continue
            sought = m.answers[p]
            plain = len(sought) > 0 and not m.content[sought[0]]
            answer = _contains(sought, b.term[begin_all[low[k]] : begin_all[high[k]]] if plain else passage)
            if share >= least_common or answer:
                mine, item = out[b.text_of[k]], m.item[p]
                mine[item] = max(mine.get(item, (0.0, 0.0, False)), (share, float(cosine[i, p]), answer))
    return out


def leaks(docs: DataFrame, model: LeakModel, text: str = "text", name: str = "leaks", least_cosine: float = 0.15, least_common: float = 0.7, least_with_answer: float = 0.5, verbatim: bool = True) -> DataFrame:
    """All columns of ``docs`` and, in ``name``, the items found in each row: item, cosine, common (share of the item's content words), answer.

    If ``docs`` has a column ``name``, that stays and the added one gets an underscore behind.
    """
    kind = "array<struct<item:int,cosine:double,common:double,answer:boolean>>"

    def make(texts: pa.Array) -> list[pa.Array]:
        cache = process_cache("leak-lookup")
        if cache.get("of") != model.vocabulary.tobytes():
            cache |= {"of": model.vocabulary.tobytes(), "find": _lookup(model.vocabulary)}
        found = find_leaks(model, texts, cache["find"], least_cosine, least_common, least_with_answer, verbatim) if model.items else [{}] * len(texts)
        rows = [[{"item": i, "cosine": c, "common": s, "answer": a} for i, (s, c, a) in sorted(x.items())] for x in found]
        return [pa.array(rows, pa.list_(pa.struct([("item", pa.int32()), ("cosine", pa.float64()), ("common", pa.float64()), ("answer", pa.bool_())])))]

    return with_text_columns(docs, text, make, [(name, kind)])


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every leak of an item of ``benchmark`` into a document, over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    benchmark = table(spark, sf_dir, "benchmark")
    model = train(docs, benchmark)
    found = leaks(docs, model).select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
    ids = spark.createDataFrame([(k, i) for k, i in enumerate(model.items)], f"item int, item_id {dict(benchmark.dtypes)['item_id']}")
    return found.join(F.broadcast(ids), "item").select("doc_id", "item_id", "cosine", "common", "answer")  # a row for each item of the query set
