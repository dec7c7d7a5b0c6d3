"""Operator 8: exact byte-level BPE encoding and decoding.

For each prefix of a piece of text there is exactly one token that can end the
encoding of that prefix. The dynamic programme stores it: of all tokens that match
as a suffix of the prefix (found by one pass of a suffix-link automaton), the right
one is compatible with the last token of what is left of it. Back-pointers then give
the ids. Two tokens are compatible if no merge across their border would have come
before the merges that made them.

Defined results: null and empty texts have no ids and decode to the empty text. A
text of any length is encoded whole; the work is linear in it. Strings of added
tokens in a text become their single id, as the tokenizers library does. Each row is
encoded by itself, so rows that repeat agree, and no two encodings of a text tie. An
empty table gives an empty result; extra columns of any name are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import process_cache, small_batches, table

# The byte-level pre-tokenizer's pattern with White_Space written out.
_WS = r"\t-\r \x85\xa0  -     　"
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
_NEVER = 1 << 40
_SHIFT = 32  # two token ids in one number
# Entries that a worker's caches may have; both together stay under some 100 MB.
_MOST_PIECES, _MOST_FITS = 250_000, 400_000


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _byte_chars() -> dict[str, int]:
    """The printable stand-in character of each byte, by the rule of byte-level BPE."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class ByteBpe:
    """Encodes and decodes with the vocabulary and merges of a tokenizers JSON file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, vocab = _byte_chars(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {vocab[a] << _SHIFT | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        # Of each token its two parts and the rank of their merge; a token that no merge makes was there from the start.
        self.left, self.right, self.born = ([-1] * (max(self.bytes_of) + 1) for _ in range(3))
        for r, (a, b) in reversed([*enumerate(pairs)]):
            self.left[vocab[a + b]], self.right[vocab[a + b]], self.born[vocab[a + b]] = vocab[a], vocab[b], r
        self.size = [len(self.bytes_of.get(i, b"")) for i in range(len(self.born))]
        self._own: dict[int, bool] = {}
        own = [i for i in vocab.values() if self._reachable(i)]
        self.whole = {self.bytes_of[i].decode("utf-8"): [i] for i in own if _is_text(self.bytes_of[i])}
        self.automaton = ahocorasick.Automaton()
        for i in own:
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pieces = regex.compile(_PIECES)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._fits: dict[int, bool] = {}
        self._ids: dict[str, list[int]] = dict(self.whole)

    def _border(self, a: int, b: int, before: int) -> bool:
        """Whether no merge across the border of two tokens comes before rank ``before``.

        The symbols at the border are followed back in time: of the two, the one that was
        made later is taken apart. Each pair that stood there must not have been merged
        before one of the two was merged away; of merges of one rank, the left comes first.
        """
        rank, left, right, born = self.rank, self.left, self.right, self.born
        a_until = b_until = before
        while True:
            r = rank.get(a << _SHIFT | b)
            if r is not None and r < a_until and r <= b_until:
                return False
            x, y = born[a], born[b]
            if x > y:
                a, a_until = right[a], x
            elif y >= 0:
                b, b_until = left[b], y
            else:
                return True

    def _reachable(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as this token."""
        if token not in self._own:
            a, b, r = self.left[token], self.right[token], self.born[token]
            self._own[token] = r < 0 or (self._reachable(a) and self._reachable(b) and self._border(a, b, r))
        return self._own[token]

    def piece(self, text: str) -> list[int]:
        """Ids of one piece of the pre-tokenizer."""
        raw, fits, size = text.encode(), self._fits, self.size
        last, ended = [-1] * len(raw), -1  # by the place of a prefix's last byte
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            if end == ended:  # matches at one end come longest first; this one has its token
                continue
            start = end - size[token]
            if start >= 0:
                before = last[start]
                fit = fits.get(before << _SHIFT | token)
                if fit is None:
                    fit = fits[before << _SHIFT | token] = self._border(before, token, _NEVER)
                if not fit:
                    continue
            last[end], ended = token, end
        out, end = [], len(raw) - 1
        while end >= 0:
            token = last[end]
            out.append(token)
            end -= size[token]
        out.reverse()
        return out

    def _plain(self, text: str) -> list[int]:
        known, pieces = self._ids, self.pieces.findall(text)
        out = [*map(known.get, pieces)]
        if None in out:
            for k, ids in enumerate(out):
                if ids is None:
                    p = pieces[k]
                    ids = out[k] = known.get(p) or self.piece(p)
                    if len(p) < 64:
                        known[p] = ids
            if len(known) > _MOST_PIECES or len(self._fits) > _MOST_FITS:  # pieces are then encoded anew
                self.forget()
        return [*chain.from_iterable(out)]

    def forget(self) -> None:
        """Empties the caches, which bounds a worker's memory."""
        self._ids = dict(self.whole)
        self._fits.clear()

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return [*chain.from_iterable([self.added[s]] if s in self.added else self._plain(s) for s in self.special.split(text))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> ByteBpe:
    """The codec of a file, built once in each Python process."""
    cache = process_cache("bpe")
    if path not in cache:
        cache[path] = ByteBpe(path)
    return cache[path]


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``ids`` array<int>, ``decoded`` string (the ids turned back into text) and the columns ``carry`` for each row.

    ``path`` names the vocabulary file on every executor. Texts go through in Arrow
    batches, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start, size, most = 0, 0, 8 << 20
            lengths = [len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts]
            for stop in range(1, len(lengths) + 1):  # slices of some MB: a batch of long texts stays small
                size += lengths[stop - 1]
                if size < most and stop < len(lengths):
                    continue
                ids = [bpe.encode(t) for t in texts.slice(start, stop - start).to_pylist()]
                own = [batch.column(c).slice(start, stop - start) for c in range(2, batch.num_columns)]
                yield pa.record_batch(
                    [keys.slice(start, stop - start), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string()), *own],
                    names=["key", "ids", "decoded", *(f"c{i}" for i in range(len(own)))],
                )
                start, size = stop, 0
        bpe.forget()

    small_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)))
    kind = dict(src.dtypes)
    own = "".join(f", c{i} {kind[f'c{i}']}" for i in range(len(carry)))
    return src.mapInArrow(run, f"key {kind['key']}, ids array<int>, decoded string{own}").toDF(key, "ids", "decoded", *carry)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of tokens, the digests of ids and decoded text, and what ``encode_decode`` carried."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *(c for c in encoded.columns if c not in (key, "ids", "decoded")),
    )


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract of query 8 over the whole of ``documents``."""
    import public_tokenizers

    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
