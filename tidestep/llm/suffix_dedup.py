"""Operator 2: long repeats, removed by a distributed suffix sort.

Every window of ``least`` (400) bytes that also starts somewhere else is a repeat; its
bytes are removed. Sorting the suffixes at all positions would move hundreds of times
the input, so the suffix array is made sparse without losing a window:

1. Each window has one anchor, the position with the least hash among its first
   ``reach`` positions. It depends on the window's bytes alone, so equal windows have
   equal anchors at equal offsets. An anchor stands for a run of adjacent windows. A
   hash of the bytes that all of them share serves to discard: an anchor whose hash
   occurs once has no window that repeats.
2. The suffixes at all other anchors (cut where the run's last window ends, then the
   bytes before the anchor) are sorted. Each task sorts its own, keeps one of equals and
   exchanges front-coded runs (length of the prefix shared with the one before, then the
   rest), cut by sampled splitters. A loser tree merges the runs of a range; it keeps the
   known common prefix of each contestant with the last winner, so known prefixes are
   never compared again. Neighbours that agree to the end repeat with all their windows.
3. Those that agree with none may still share some windows with others of their hash;
   they lie at the ends of repeats. Steps 1 and 2 are done again there with a short
   reach, and what is left is sorted window by window in the same way.

So every repeat is found by the merge, byte by byte. Each task sends a suffix once
however often it holds it, so a range gets at most one of equals from each chunk.

``passages`` does the same with words in place of bytes: a passage of little
over 50 words mostly has under 400 bytes, so ``repeats`` rightly leaves it in, and a column
of its own tells which texts hold one. White space parts words, however much of it. Copies
of whole texts repeat as such: anchors that only copies of one text have, at the same
place, by 64 bits of text and place and 64 of the shared words, are settled without a merge.

Defined results: null and empty texts have no bytes and lose none; so do texts under
``least`` bytes. An empty table gives an empty result. Rows are told apart by key and
text, a null key being a key like any other; rows that repeat as a whole are copies of
each other and agree in what they lose. All copies of a repeat go, so there are no ties.
Extra columns are left out, whatever their names. Texts of any length are handled whole,
in slices.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import process_cache, stored, table

_SLICE = 1 << 21
_TOGETHER = 1 << 19
_GRAM = 16


def _tables() -> dict:
    """Byte values and powers of the range hash."""
    t = process_cache("range-hash")
    if not t:
        base, r = 0xD1342543DE82EF95, np.random.default_rng(400)

        def powers(b: int) -> np.ndarray:
            out = np.full(_SLICE + 4096, b, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        t |= {"value": r.integers(0, 1 << 64, 256, dtype=np.uint64), "up": powers(base), "down": powers(pow(base, -1, 1 << 64))}
    return t


def word_values(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that stand one after another in some bytes, from ``starts`` on: a hash of each word, and the first word of each text.

    A word's hash depends on its bytes alone. The words are those of ``bytes.split``.
    """
    t = _tables()
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begins = np.zeros(len(raw), bool)
    begins[1:] = space[:-1]
    begins[starts[starts < len(raw)]] = True
    begins &= ~space
    first = np.searchsorted(np.flatnonzero(begins), starts)
    values, at = [], 0
    while at < len(raw):
        stop = min(at + _SLICE, len(raw))
        while stop < len(raw) and not space[stop]:  # a word that is longer than a slice stays whole
            more = np.flatnonzero(space[stop : stop + _SLICE])
            stop = stop + int(more[0]) if len(more) else min(stop + _SLICE, len(raw))
        new = begins[at:stop]
        words = np.flatnonzero(new)
        if len(words):
            places = np.arange(stop - at)
            places -= np.maximum.accumulate(np.where(new, places, 0))
            v = t["value"][raw[at:stop]] * t["up"][places & 0xFFFF]
            v[space[at:stop]] = 0
            v = np.add.reduceat(v, words)
            v ^= v >> np.uint64(32)
            values.append(v * np.uint64(0x9E3779B97F4A7C15))
        at = stop
    return np.concatenate(values) if values else np.zeros(0, np.uint64), first


def anchors(raw: np.ndarray, starts: np.ndarray, least: int, reach: int) -> tuple[np.ndarray, ...]:
    """Of texts that stand one after another in some bytes, from ``starts`` on: hash of the bytes that all its windows share, text, anchor, first and last window of each anchor.

    Places count from the beginning of the text. No window reaches into another text.
    In place of bytes there may be the hashes of words, for windows of words.
    """
    if len(raw) < least:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    n = len(raw) - least + 1
    if n > _SLICE:  # one long text; an anchor at a cut stands for two runs of windows
        parts = [anchors(raw[at : at + _SLICE + least - 1], starts, least, reach) for at in range(0, n, _SLICE)]
        return tuple(np.concatenate([x[c] + (k * _SLICE if c > 1 else 0) for k, x in enumerate(parts)]) for c in range(5))
    t = _tables()
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((t["value"][raw] if raw.dtype == np.uint8 else raw) * t["up"][: len(raw)], out=sums[1:])
    grams = n + reach - 1
    v = (sums[_GRAM : _GRAM + grams] - sums[:grams]) * t["down"][:grams]
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v >>= np.uint64(32)
    v <<= np.uint64(24)
    v |= np.arange(grams, dtype=np.uint64)  # of equals, the first
    span = 1
    while 2 * span <= reach:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    v = np.minimum(v[:n], v[reach - span : reach - span + n])
    at = (v & np.uint64((1 << 24) - 1)).astype(np.int64)
    stops = np.append(starts[1:], len(raw))
    live = np.flatnonzero(stops - starts >= least)
    if not len(live):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    change = np.zeros(n + 1, np.int8)  # windows within one text
    np.add.at(change, starts[live], 1)
    np.add.at(change, stops[live] - least + 1, -1)
    within = np.cumsum(change[:-1], dtype=np.int8) > 0
    new = np.ones(n, bool)
    new[1:] = at[1:] != at[:-1]
    new[starts[live]] = True
    lo = np.flatnonzero(new & within)
    text = np.searchsorted(starts, lo, "right") - 1
    hi = stops[text] - least
    hi[:-1] = np.minimum(hi[:-1], lo[1:] - 1)
    a, first = at[lo], starts[text]
    shared = (sums[a + (least - reach + 1)] - sums[a]) * t["down"][a]
    return shared.view(np.int64), text, a - first, lo - first, hi - first


def _anchor_rows(texts: DataFrame, kind: str, least: int, reach: int, only_hashes: bool, words: bool = False) -> DataFrame:
    """A row for each anchor; with ``words`` everything counts in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_ = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(texts_.buffers()[1], np.int64)[texts_.offset : texts_.offset + len(texts_) + 1]
            raw, first = np.frombuffer(texts_.buffers()[2] or b"", np.uint8), 0
            while first < len(texts_):  # as many texts at once as have some bytes together, one at least
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _TOGETHER, "right")) - 1)
                part = raw[offsets[first] : offsets[last]], offsets[first:last] - offsets[first]
                hb, text, *places = anchors(*(word_values(*part) if words else part), least, reach)
                if only_hashes:
                    yield pa.record_batch([pa.array(hb)], names=["hb"])
                else:
                    own = [batch.column(c).take(pa.array(text + first)) for c in range(2)]
                    yield pa.record_batch([*own, pa.array(hb), *(pa.array(x.astype(np.int32)) for x in places)], names=["k", "h", "hb", "a", "lo", "hi"])
                first = last

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n > 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return texts.mapInArrow(gathered, "hb long" if only_hashes else f"k {kind}, h long, hb long, a int, lo int, hi int")


def _with_marks(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """The texts that have ``marks`` (k, h and other columns), with those of each text in ``marks``."""
    own = F.struct(*(c for c in marks.columns if c not in ("k", "h")))
    lists = marks.groupBy("k", "h").agg(F.collect_list(own).alias("marks")).withColumnsRenamed({"k": "k2", "h": "h2"})
    joined = texts.drop("marks").join(lists, (F.col("h") == F.col("h2")) & F.col("k").eqNullSafe(F.col("k2")))
    return joined.drop("k2", "h2")


def settle(texts: DataFrame, kind: str, least: int, reach: int, name: str, words: bool = False, **sizes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts that may have repeats; ``k``, ``h``, ``lo``, ``hi`` of runs of windows that repeat; runs of which some windows may, and their bytes (``piece``).

    ``texts`` has ``k``, ``h`` and ``t`` (binary). The last result holds every window that is
    not settled, with one of each that it may equal.
    """
    each = lambda hashes: _anchor_rows(texts, kind, least, reach, hashes, words)
    shared = stored(each(True).groupBy("hb").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hb"), f"{name}-shared")
    maybe = stored(_with_marks(texts, each(False).join(shared, "hb")), f"{name}-texts")
    return maybe, *sort_out(maybe, kind, least, reach, name, words, **sizes)


def sort_out(maybe: DataFrame, kind: str, least: int, reach: int, name: str, words: bool = False, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """The last two results of ``settle`` from its first one."""
    core = least - reach + 1
    found = stored(merged(maybe, kind, least, core=2 * core - 1 if words else core, words=words, **sizes), f"{name}-merged")
    one = found.where("one")
    mixed = one.groupBy("hb").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("repeats")).alias("lone")).where("n > 1 AND lone > 0")
    left = one.join(stored(mixed.select("hb"), f"{name}-mixed"), "hb")
    return found.where("repeats").select("k", "h", "lo", "hi"), left.select("k", "h", "hb", "lo", "hi", "piece")


def front_code(suffixes: list[bytes]) -> tuple[list[int], bytes]:
    """Of sorted byte strings: the prefix shared with the one before (0 for the first), and what follows it, joined."""
    lcps = [0] * bool(suffixes)
    while len(lcps) < len(suffixes):
        part = suffixes[len(lcps) - 1 : len(lcps) + 1023]
        sizes = np.array([len(x) for x in part])
        wide = int(sizes.max()) + 1
        if wide * len(part) > _SLICE:  # a few long ones
            lcps += [common_prefix(a, b, 0) for a, b in zip(part, part[1:])]
        else:  # side by side; behind their ends all differ
            bytes_ = np.array(part, f"S{wide}").view(np.uint8).reshape(len(part), wide)
            differ = bytes_[1:] != bytes_[:-1]
            least = np.minimum(sizes[1:], sizes[:-1])
            differ[np.arange(len(least)), least] = True
            lcps += differ.argmax(axis=1).tolist()
    return lcps, b"".join([x[n:] for x, n in zip(suffixes, lcps, strict=True)])


class Run:
    """A front-coded run that is read one suffix at a time."""

    def __init__(self, lcps: list[int], sizes: list[int], tails: bytes):
        self.lcps, self.sizes, self.tails = lcps, sizes, tails
        self.at, self.read, self.suffix, self.lcp = -1, 0, b"", 0
        self.forward()

    def forward(self) -> None:
        """To the next suffix; ``lcp`` is what it shares with the one before."""
        self.at += 1
        if self.at >= len(self.lcps):
            self.suffix, self.lcp = None, -1
            return
        self.lcp = self.lcps[self.at]
        stop = self.read + self.sizes[self.at] - self.lcp
        self.suffix = self.suffix[: self.lcp] + self.tails[self.read : stop]
        self.read = stop


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two byte strings, of which ``known`` bytes are."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    step = 16
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(high, low + step)
    differ = int.from_bytes(a[low:high], "little") ^ int.from_bytes(b[low:high], "little")
    return low + ((differ & -differ).bit_length() - 1 >> 3)


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """Run, place in the run and prefix shared with the suffix before, of all suffixes in order.

    The runs stand in a loser tree. Each loser keeps the prefix it shares with the
    suffix that beat it; of two contestants for the place after one suffix, the longer
    shared prefix wins, and only equals are compared, from that prefix on.
    """
    n = 1
    while n < len(runs):
        n *= 2
    lcp = [r.lcp for r in runs] + [-1] * (n - len(runs))
    suffix = [r.suffix for r in runs] + [None] * (n - len(runs))
    tree = [-1] * n

    def match(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix becomes that with the winner."""
        if lcp[x] != lcp[y]:
            return (x, y) if lcp[x] > lcp[y] else (y, x)
        a, b = suffix[x], suffix[y]
        if a is None or b is None:
            return (x, y) if b is None else (y, x)
        n = common_prefix(a, b, lcp[x])
        if n < len(a) and (n == len(b) or a[n] > b[n]):
            x, y = y, x
        lcp[y] = n
        return x, y

    best = [*range(n)]  # the first round, from the leaves up
    while len(best) > 1:
        winners = []
        for i in range(0, len(best), 2):
            won, lost = match(best[i], best[i + 1])
            tree[(len(best) + i) // 2] = lost
            winners.append(won)
        best = winners
    w = best[0]
    while suffix[w] is not None:
        r = runs[w]
        yield w, r.at, lcp[w]
        r.forward()
        suffix[w], own = r.suffix, r.lcp
        node = (w + n) >> 1
        while node:
            other = tree[node]
            if own < lcp[other]:
                lcp[w], own = own, lcp[other]
                w, tree[node] = other, w
            elif own == lcp[other]:
                lcp[w] = own
                w, tree[node] = match(w, other)
            node >>= 1
        lcp[w] = own


def separators(seen: list[bytes], ranges: int) -> list[bytes]:
    """Splitters of sorted samples into ranges of like numbers, each as short as it can be."""
    out = []
    for i in range(1, ranges):
        at = len(seen) * i // ranges
        if at and seen[at] > seen[at - 1]:
            out.append(seen[at][: common_prefix(seen[at - 1], seen[at], 0) + 1])
    return out


def flat(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of lists of marks without nulls: where each begins (and the last ends) among all marks, and these by column."""
    marks = lists.flatten()
    return np.append(0, np.cumsum(pyarrow.compute.list_value_length(lists).to_numpy(), dtype=np.int64)), {f.name: marks.field(f.name).to_numpy() for f in marks.type}


def merged(texts: DataFrame, kind: str, least: int, core: int = 0, words: bool = False, chunk: int = 32_768, per_range: int = 65_536) -> DataFrame:
    """``k``, ``h``, ``hb``, ``lo``, ``hi``, ``repeats``, ``one``, ``piece`` of the ``marks`` of ``texts``, by the merge sort of their suffixes.

    ``repeats``: another mark has the same suffix. ``one``: of marks with the same suffix,
    one has it; if it shares its first ``core`` bytes with a neighbour (or stands at the end
    of a range), ``piece`` has the bytes of its windows. Without ``core`` each window of the
    marks is a suffix of its own (``lo`` = ``hi``), and only those that repeat are returned.
    With ``words`` all but ``core`` counts in words, and one space parts those of a suffix or piece.

    A task holds ``chunk`` suffixes, or the front-coded runs of one range of about
    ``per_range``, however many ranges there are. The driver sees four sampled suffixes a range.
    """
    count = F.aggregate("marks", F.lit(0).cast("long"), lambda s, m: s + m["hi"] - m["lo"] + 1) if not core else F.size("marks").cast("long")
    total = texts.agg(F.sum(count)).first()[0] or 0
    ranges = max(1, -(-total // per_range))
    every = max(1, total // (4 * ranges))

    def places(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of the marks of some texts: which suffixes each text has, and ``hb``, ``a``, ``lo``, ``hi`` of all suffixes."""
        bounds, marks = flat(lists)
        lo, hi = marks["lo"], marks["hi"]
        if core:
            return bounds, [marks["hb"], marks["a"], lo, hi]
        n = hi - lo + 1
        ends = np.append(0, np.cumsum(n, dtype=np.int64))
        at = (np.repeat(lo - ends[:-1], n) + np.arange(ends[-1])).astype(np.int32)
        return ends[bounds], [np.zeros(len(at), np.int64), at, at, at]

    def suffixes(raw: bytes, starts: list[int], los: list[int], his: list[int]) -> list[bytes]:
        """Those of one text, from their anchors on."""
        if not words:
            if not core:
                return [raw[p : p + least] for p in los]
            return [raw[a : hi + least] + raw[lo:a] + struct.pack(">II", hi + least - a, a - lo) for a, lo, hi in zip(starts, los, his, strict=True)]
        own, joined = raw.split(), b" ".join
        if not core:
            return [joined(own[p : p + least]) for p in los]
        out = []
        for a, lo, hi in zip(starts, los, his, strict=True):
            ahead, back = joined(own[a : hi + least]), joined(own[lo:a])
            back += b" " if back else b""
            out.append(ahead + back + struct.pack(">II", len(ahead), len(back)))
        return out

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, seen = [], 0
        for batch in batches:
            bounds, (_, *at) = places(batch.column(1))
            for i in range((every // 2 - seen) % every, int(bounds[-1]), every):  # no other suffix is made
                row = int(np.searchsorted(bounds, i, "right")) - 1
                kept += suffixes(batch.column(0)[row].as_py(), *([int(x[i])] for x in at))
            seen += int(bounds[-1])
        yield pa.record_batch([pa.array(kept, pa.binary())], names=["s"])

    splitters: list[bytes] = []
    if ranges > 1:
        splitters = separators(sorted(texts.select("t", "marks").mapInArrow(sample, "s binary").toArrow().column("s").to_pylist()), ranges)
    run_names = ["part", "lcps", "sizes", "tails", "again", "k", "h", "hb", "lo", "hi"]

    def coded(held: list[bytes], ids: list[pa.Array]) -> pa.RecordBatch:
        """A sorted chunk as one run for each range; of equals the first, the others apart (they repeat, whatever is merged)."""
        order = np.array(sorted(range(len(held)), key=held.__getitem__))
        ordered = [held[i] for i in order.tolist()]
        new = np.array([True, *(x != y for x, y in zip(ordered[1:], ordered))])
        again = ~np.append(new[1:], True)[new]
        rest = order[~new]
        ordered = [ordered[i] for i in np.flatnonzero(new).tolist()]
        ends = [0]
        for s in splitters:
            ends.append(bisect_left(ordered, s, ends[-1]))
        ends.append(len(ordered))
        parts, stops, lcps, tails = [], [0], [], []
        for part, (a, b) in enumerate(zip(ends, ends[1:])):
            if a < b:
                own, tail = front_code(ordered[a:b])
                parts.append(part)
                stops.append(b)
                lcps += own
                tails.append(tail)
        sizes, own_stops = [len(x) for x in ordered], [*stops]
        if len(rest):  # to any range, the same one if the task runs again
            parts.append(zlib.crc32(ordered[0]) % ranges)
            stops.append(stops[-1])
            own_stops.append(len(order))
            tails.append(b"")
        lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), x)
        taken = pa.array(np.concatenate([order[new], rest]))
        columns = [pa.array(parts, pa.int32()), lists(stops, pa.array(lcps, pa.int32())), lists(stops, pa.array(sizes, pa.int32())), pa.array(tails, pa.binary()), lists(stops, pa.array(again))]
        return pa.record_batch([*columns, *(lists(own_stops, x.take(taken)) for x in ids)], names=run_names)

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        ids: list[list[pa.Array]] = [[] for _ in range(5)]
        for batch in batches:
            bounds, at = places(batch.column(3))
            lists, rows = [x.tolist() for x in at[1:]], np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            done = 0  # of this batch, as far as ids have them

            def take(stop: int) -> None:
                own = pa.array(rows[done:stop])  # noqa: B023
                for c, x in zip(ids, (batch.column(0).take(own), batch.column(1).take(own), *(pa.array(at[c][done:stop]) for c in (0, 2, 3))), strict=True):  # noqa: B023
                    c.append(x)

            for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                raw = batch.column(2)[row].as_py()
                while a < b:
                    stop = min(b, a + chunk - len(held))
                    held += suffixes(raw, *(x[a:stop] for x in lists))
                    a = stop
                    if len(held) >= chunk:
                        take(a)
                        yield coded(held, [pa.concat_arrays(x) for x in ids])
                        held, ids, done = [], [[] for _ in range(5)], a
            take(len(rows))
        if held:
            yield coded(held, [pa.concat_arrays(x) for x in ids])

    names = ["k", "h", "hb", "lo", "hi", "repeats", "one", "piece"]

    def in_order(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, begins, held, n = [], [], [[] for _ in range(6)], 0
        for batch in batches:
            for row in range(batch.num_rows):
                own = [batch.column(c)[row].values for c in run_names[5:]]
                lcps = batch.column("lcps")[row].values
                if len(lcps):
                    runs.append(Run(lcps.to_numpy().tolist(), batch.column("sizes")[row].values.to_numpy().tolist(), batch.column("tails")[row].as_py()))
                    begins.append(n)
                    n += len(lcps)
                    for c, x in zip(held, [*own, batch.column("again")[row].values], strict=True):
                        c.append(x)
                else:
                    m = len(own[0])
                    yield pa.record_batch([*own, pa.array([True] * m), pa.array([False] * m), pa.array([None] * m, pa.binary())], names=names)
        if not runs:
            return
        *ids, again = [pa.concat_arrays(c) for c in held]
        again = again.to_numpy(zero_copy_only=False)
        held.clear()
        at: list[int] = []  # places among ids, in order
        equal: list[bool] = []  # to the one before
        pieces: dict[int, bytes] = {}  # by place in ``at``: of equals, the first has it

        def flush() -> pa.RecordBatch:
            taken, same = np.array(at), np.array(equal)
            repeats = same | again[taken]
            repeats[:-1] |= same[1:]
            if core:
                piece = [None] * len(at)
                for i, x in pieces.items():
                    piece[i] = x
            else:
                taken, same, repeats = taken[repeats], same[repeats], repeats[repeats]
                piece = [None] * len(taken)
            taken = pa.array(taken)
            made = pa.record_batch([*(x.take(taken) for x in ids), pa.array(repeats), pa.array(~same), pa.array(piece, pa.binary())], names=names)
            for c in (at, equal, pieces):
                c.clear()
            return made

        def bytes_of(suffix: bytes) -> bytes:
            """The windows' bytes in their order: what stands before the anchor comes last in a suffix."""
            ahead, back = struct.unpack(">II", suffix[-8:])
            return suffix[ahead : ahead + back] + suffix[:ahead]

        size, first = 0, -1  # of the suffix before, and where the first of its equals stands in ``at``
        before = b""
        for r, i, lcp in merge(runs):
            run = runs[r]
            if lcp == size == run.sizes[i]:
                equal.append(True)
            else:
                near = core and (lcp >= core or first < 0)
                if near:
                    if first >= 0 and first not in pieces:
                        pieces[first] = bytes_of(before)
                elif len(at) >= 50_000:
                    yield flush()
                equal.append(False)
                size, before, first = run.sizes[i], run.suffix, len(at)
                if near:
                    pieces[first] = bytes_of(before)
            at.append(begins[r] + i)
        if core and first not in pieces:
            pieces[first] = bytes_of(before)
        yield flush()

    runs = texts.select("k", "h", "t", "marks").mapInArrow(sorted_runs, f"part int, lcps array<int>, sizes array<int>, tails binary, again array<boolean>, k array<{kind}>, h array<long>, hb array<long>, lo array<int>, hi array<int>")
    return runs.groupBy("part").applyInArrow(in_order, f"k {kind}, h long, hb long, lo int, hi int, repeats boolean, one boolean, piece binary")


def _finer(some: DataFrame, kind: str, least: int, near: int, name: str, words: bool = False, **sizes: int) -> DataFrame:
    """``k``, ``h``, ``lo``, ``hi`` of the runs of windows that repeat among those ``settle`` left."""
    # From here on a piece of a text, told apart by where it begins, stands for the text.
    piece = lambda rows, k, at: rows.select(F.struct(F.col(k).alias("k"), at.cast("int").alias("at")).alias("k"), "h", F.col("piece").alias("t"))
    own = lambda rows: rows.select("k.k", "h", (F.col("k.at") + F.col("lo")).alias("lo"), (F.col("k.at") + F.col("hi")).alias("hi"))
    part = f"struct<k:{kind},at:int>"
    _, fine, few = settle(stored(piece(some, "k", F.col("lo")), f"{name}pieces"), part, least, near, f"{name}near-anchors", words, **sizes)
    size = F.size(F.split(F.col("t").cast("string"), " ")) if words else F.octet_length("t")
    all_windows = F.array(F.struct(F.lit(0).alias("lo"), (size - least).cast("int").alias("hi")))
    late = merged(stored(piece(few, "k.k", F.col("k.at") + F.col("lo")).withColumn("marks", all_windows), f"{name}late-pieces"), part, least, words=words, **sizes)
    return own(fine).unionByName(own(late))


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 51, reach: int = 35, near: int = 8, known: DataFrame | None = None, **sizes: int) -> DataFrame:
    """``k`` and ``h`` of each text with ``least`` words in a row that also begin anywhere else, in the same text or another one.

    ``h`` is xxhash64 of the text (null as empty). ``sizes`` are those of ``merged``.
    Texts that are ``known`` (``k``, ``h``) to hold one may be left out of the result. They
    stay in what the others are held against; an anchor hash that only such texts have
    has nothing left to decide, and is not merged.
    """
    if not near <= reach <= least - _GRAM:
        raise ValueError("near <= reach <= least - 16")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(key).alias("k"), F.xxhash64(body).alias("h"), body.cast("binary").alias("t")).where(F.octet_length("t") >= 2 * least - 1)
    kind = dict(texts.dtypes)["k"]
    rows, place = stored(_anchor_rows(texts, kind, least, reach, False, words=True), "word-anchors"), F.xxhash64("h", "lo")
    of_hash = rows.groupBy("hb").agg(F.count(F.lit(1)).alias("n"), (F.min(place) != F.max(place)).alias("differ")).where("n > 1")
    hits = stored(rows.join(stored(of_hash.select("hb", "differ"), "word-shared"), "hb"), "word-hits")
    copies = hits.where("NOT differ").select("k", "h")
    sure = stored((copies.unionByName(known.select("k", "h")) if known else copies).dropDuplicates(["k", "h"]), "word-known")
    marks = stored(_undecided(hits.where("differ").drop("differ"), sure), "word-marks")
    maybe = stored(_with_marks(texts, marks), "word-texts")
    whole, some = sort_out(maybe, kind, least, reach, "words", words=True, **sizes)
    sure = stored(sure.unionByName(whole.select("k", "h")).dropDuplicates(["k", "h"]), "word-settled")
    found = _finer(_undecided(some, sure), kind, least, near, "word-", words=True, **sizes).select("k", "h")
    return found.unionByName(sure).dropDuplicates(["k", "h"])


def _undecided(rows: DataFrame, sure: DataFrame) -> DataFrame:
    """The ``rows`` of each hash ``hb`` that a text has which is not in ``sure`` (``k``, ``h``)."""
    own = sure.toDF("k2", "h2")
    open_ = rows.select("k", "h", "hb").join(own, (F.col("h") == F.col("h2")) & F.col("k").eqNullSafe(F.col("k2")), "left_anti").select("hb").distinct()
    return rows.join(open_, "hb", "left_semi")


def whole_words(raw: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Words with white space on both sides in each window of ``least`` bytes: wherever its bytes occur, these are words."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    before = np.append(True, space[:-1])[: len(raw)]
    begins, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    return np.maximum(np.searchsorted(ends, starts + least) - np.searchsorted(begins, starts, "right"), 0)


def _whole_words(window: bytes) -> int:
    """Those of a single window."""
    return int(whole_words(np.frombuffer(window, np.uint8), np.zeros(1, np.int64), len(window))[0])


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 400, reach: int = 160, near: int = 16, words: int = 51, **sizes: int) -> DataFrame:
    """``k``, ``h``, ``spans`` (removed byte runs: start, stop), ``kept`` (the other bytes) and ``passage`` of each text that loses a byte.

    ``passage``: the first window of a repeated run holds ``words`` whole words. ``h`` is xxhash64 of the text (null as empty). Rows that repeat as a whole have one row here.
    ``sizes`` are those of ``merged``.
    """
    if not near <= reach <= least - _GRAM:
        raise ValueError("near <= reach <= least - 16")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(key).alias("k"), F.xxhash64(body).alias("h"), body.cast("binary").alias("t")).where(F.octet_length("t") >= least)
    kind = dict(texts.dtypes)["k"]
    maybe, whole, some = settle(texts, kind, least, reach, "anchors", **sizes)
    gone = stored(whole.unionByName(_finer(some, kind, least, near, "", **sizes)), "repeated-windows")
    ready = _with_marks(maybe, gone)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_ = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            bounds, marks = flat(batch.column("marks"))
            spans, kept, passage = [], [], []
            for row in range(batch.num_rows):
                raw, own = batch.column("t")[row].as_py(), slice(bounds[row], bounds[row + 1])
                order = np.argsort(marks["lo"][own])
                lo, stop = marks["lo"][own][order], np.maximum.accumulate(marks["hi"][own][order] + least)
                gaps = lo[1:] > stop[:-1]
                starts, stops = lo[np.append(True, gaps)].tolist(), stop[np.append(gaps, True)].tolist()
                spans.append([{"start": a, "stop": b} for a, b in zip(starts, stops, strict=True)])
                kept.append(b"".join([raw[a:b] for a, b in zip([0, *stops], [*starts, len(raw)], strict=True)]))
                passage.append(bool((whole_words(np.frombuffer(raw, np.uint8), lo, least) >= words).any()))
            yield pa.record_batch([batch.column("k"), batch.column("h"), pa.array(spans, kind_), pa.array(kept, pa.binary()), pa.array(passage, pa.bool_())], names=["k", "h", "spans", "kept", "passage"])

    done = ready.select("k", "h", "t", "marks").mapInArrow(cut, f"k {kind}, h long, spans array<struct<start:int,stop:int>>, kept binary, passage boolean")
    return done


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract of query 2 over the whole of ``documents``; then ``has_repeat`` (``n_removed`` > 0) and ``has_passage`` (more than 50 words in a row that also begin elsewhere, whatever their bytes)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeats(docs).select(
        "k",
        F.col("h").alias("h2"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept"),
        F.col("passage").alias("has_passage"),
    )
    found = stored(found, "removed")
    more = passages(docs, known=found.where("has_passage").select("k", F.col("h2").alias("h"))).select("k", F.col("h").alias("h2"), F.lit(True).alias("has_passage"))
    both = found.unionByName(more, allowMissingColumns=True)
    found = both.groupBy("k", "h2").agg(*(F.max(c).alias(c) for c in ("n_removed", "n_spans", "kept", "has_passage")))
    body = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", F.xxhash64(body).alias("h"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("sha"))
    out = own.join(found, (F.col("h") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("k")), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"),
        F.col("n_removed").isNotNull().alias("has_repeat"), F.coalesce("has_passage", F.lit(False)).alias("has_passage"),
    )
