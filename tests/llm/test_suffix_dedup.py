import hashlib
import os
import random
import sys

import numpy as np
import pytest

from tidestep.llm import suffix_dedup as s


def brute(texts, least):
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - least + 1):
            seen.setdefault(t[p : p + least], []).append((i, p))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + least] = b"\1" * least
    out = []
    for t, g in zip(texts, gone):
        spans = sum(1 for a, b in zip(b"\0" + g, g) if b and not a)
        out.append((len(t), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(t, g) if not y)).hexdigest()))
    return out


def test_merge_is_sorted_and_exact():
    r = random.Random(1)
    for n_runs in (1, 2, 3, 7, 16):
        words = [bytes(r.choice(b"ab") for _ in range(r.randint(6, 12))) for _ in range(200)]
        owned = [sorted(words[i::n_runs]) for i in range(n_runs)]
        coded = [s.front_code(ws) for ws in owned]
        runs = [s.Run(lcps, [*map(len, ws)], tails) for (lcps, tails), ws in zip(coded, owned)]
        got = [(owned[i][k], l) for i, k, l in s.merge(runs)]
        assert [w for w, _ in got] == sorted(words)
        for (a, _), (b, l) in zip(got, got[1:]):
            assert l == len(os.path.commonprefix([a, b]))


def test_separators_are_short_and_part_the_samples():
    seen = sorted([b"aaab", b"aaac", b"ab", b"b", b"b", b"b", b"ca", b"cb"])
    assert s.separators(seen, 8) == [b"aaac", b"ab", b"b", b"c", b"cb"] and s.separators(seen, 1) == []


def test_anchors_depend_on_the_window_alone():
    r = np.random.default_rng(2)
    part = r.integers(97, 101, 700, dtype=np.uint8)
    a = np.concatenate((r.integers(97, 101, 333, dtype=np.uint8), part))
    b = np.concatenate((part, r.integers(97, 101, 90, dtype=np.uint8)))
    of = {}
    for name, x, at in (("a", a, 333), ("b", b, 0)):
        hb, text, anchor, lo, hi = s.anchors(x, np.zeros(1, np.int64), 400, 160)
        assert lo[0] == 0 and hi[-1] == len(x) - 400 and (lo[1:] == hi[:-1] + 1).all() and ((anchor >= hi) & (anchor - lo < 160)).all()
        of[name] = {p - at: (int(h), int(c) - at) for h, c, u, v in zip(hb, anchor, lo, hi) for p in range(u, v + 1)}
    assert all(of["a"][p] == of["b"][p] for p in range(301))


def test_anchors_of_texts_together_are_those_of_each():
    r = np.random.default_rng(6)
    texts = [r.integers(97, 101, n, dtype=np.uint8) for n in (0, 399, 400, 1500, 0, 401, 12, 2000, 30)]
    starts = np.cumsum([0, *map(len, texts[:-1])])
    got = [*zip(*(x.tolist() for x in s.anchors(np.concatenate(texts), starts, 400, 160)))]
    want = []
    for i, t in enumerate(texts):
        want += [(h, i, *rest) for h, _, *rest in zip(*(x.tolist() for x in s.anchors(t, np.zeros(1, np.int64), 400, 160)))]
    assert got == want and len({x[1] for x in got}) == 4


def corpus(seed, least):
    r = random.Random(seed)
    make = lambda n: bytes(r.choice(b"abcdefgh \n") for _ in range(n))
    base = [make(r.randint(least, 4 * least)) for _ in range(6)]
    texts = [b"", make(least - 1), b"a" * (3 * least), b"ab" * least, b"a" * (least + 1)]
    for _ in range(50):
        parts = []
        for _ in range(r.randint(1, 4)):
            x = bytearray(r.choice(base))
            a = r.randrange(len(x))
            x = x[a : a + r.randint(1, len(x))] if r.random() < 0.5 else x
            for _ in range(r.choice([0, 0, 1, 2])):
                if x:
                    x[r.randrange(len(x))] = r.choice(b"xyz")
            parts.append(bytes(x))
            if r.random() < 0.5:
                parts.append(make(r.randint(0, 30)))
        texts.append(b"".join(parts))
    return texts + texts[7:9]


@pytest.mark.parametrize("seed,least,reach,near", [(1, 60, 30, 8), (2, 40, 20, 20), (3, 90, 70, 4)])
def test_operator_against_brute_force(spark, seed, least, reach, near):
    texts = corpus(seed, least)
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    # Small chunks and ranges: many runs meet in each of many ranges.
    got = {r.k: r for r in s.repeats(df, least=least, reach=reach, near=near, chunk=37, per_range=64).collect()}
    for i, (n, removed, spans, sha) in enumerate(brute(texts, least)):
        if not removed:
            assert i not in got
            continue
        x = got[i].spans
        assert (sum(y.stop - y.start for y in x), len(x), hashlib.sha256(got[i].kept).hexdigest()) == (removed, spans, sha), i


def test_query_on_edges(spark, tmp_path):
    r = random.Random(4)
    long = "".join(r.choice("abcdeé ") for _ in range(6000))
    texts = [None, "", "x" * 399, "x" * 400, "y" * 401, long, long[:3000] + "Q" + long[3000:], "zz" + long[100:499] + "é", long[2000:2500] * 3, long, "é" * 500, "w" * 90000]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, h int, k int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in s.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute([(t or "").encode() for t in texts], 400)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i


def test_repeated_rows_and_null_ids(spark, tmp_path):
    t = "".join(random.Random(5).choice("abcdef") for _ in range(900))
    spark.createDataFrame([(1, t), (1, t), (None, t + "x"), (2, "short"), (2, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in s.op2_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == [(0, 901, 900), (1, 900, 900), (1, 900, 900), (2, 5, 0), (2, 5, 0)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert s.op2_suffix_dedup(spark, str(tmp_path)).count() == 0


def brute_passages(texts, least):
    seen, words = {}, [t.split() for t in texts]
    for i, w in enumerate(words):
        for p in range(len(w) - least + 1):
            seen.setdefault(tuple(w[p : p + least]), []).append(i)
    return {i for places in seen.values() if len(places) > 1 for i in places}


def test_word_values_depend_on_the_word_alone(monkeypatch):
    texts = [b"", b"one two  one\n", b"\x0bone\tlonger-word", b" ", b"two", "é onetwo".encode()]
    starts, raw = np.cumsum([0, *map(len, texts[:-1])]), np.frombuffer(b"".join(texts), np.uint8)
    words = [w for t in texts for w in t.split()]
    for size in (1 << 21, 4):
        monkeypatch.setattr(s, "_SLICE", size)
        got, first = s.word_values(raw, starts)
        assert len(got) == len(words) and first.tolist() == [0, 0, 3, 5, 5, 6]
        assert all((a == b) == (x == y) for a, x in zip(got, words) for b, y in zip(got, words))
    assert [len(x) for x in s.word_values(raw[:0], starts[:2] * 0)] == [0, 2]


@pytest.mark.parametrize("seed,least,reach,near", [(1, 30, 12, 3), (2, 20, 4, 4), (3, 51, 35, 8)])
def test_passages_against_brute_force(spark, seed, least, reach, near):
    r = random.Random(seed)
    make = lambda n: [r.choice(["a", "of", "thé", "word", "longer", "x" * 30]) for _ in range(n)]
    base = [make(r.randint(least, 3 * least)) for _ in range(25)]
    texts = ["", "a " * (least - 1), "b " * least, "c " * (least + 1)]
    for i in range(100):
        x = list(r.choice(base))
        if r.random() < 0.8:
            x = x[r.randrange(len(x) - least // 2) :][: r.randint(least - 2, least + 2)]
        if r.random() < 0.3:
            x[r.randrange(len(x))] = f"own{i}"
        texts.append(r.choice([" ", "\n", " \t"]).join([*make(r.randint(0, 40)), *x, *make(r.randint(0, 40))]))
    texts += texts[7:10] + [" ".join(make(2 * least))] * 2
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.k for r in s.passages(df, least=least, reach=reach, near=near, chunk=37, per_range=64).collect()}
    want = brute_passages(texts, least)
    assert got == want and 20 < len(want) < 90
    known = df.where(df.doc_id.isin([*want][::2])).selectExpr("doc_id AS k", "xxhash64(text) AS h")
    rest = {r.k for r in s.passages(df, least=least, reach=reach, near=near, known=known, chunk=37, per_range=64).collect()}
    assert rest == want


def test_query_tells_of_passages_under_400_bytes(spark, tmp_path):
    word = iter(f"{chr(97 + i % 26)}{i}" for i in range(10**6))
    own = lambda n: " ".join(next(word) for _ in range(n))
    long, short, copy = own(51), own(50), own(60)
    texts = [f"{own(90)} {long} {own(3)}", f"{own(5)} {long} {own(70)}", f"{own(30)} {short} {own(3)}", f"{short} {own(30)}", own(300), copy, copy, f"{own(9)}\n" + long.replace(" ", "\n"), own(50), None, ""]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in s.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].has_passage for i in range(len(texts))] == [True, True, False, False, False, True, True, True, False, False, False]
    assert not any(got[i].n_removed or got[i].has_repeat for i in range(len(texts)))


def test_whole_words_of_a_window():
    assert [s._whole_words(w) for w in (b"", b"abc", b" ", b"a b", b"a b c", b" b ", b"\nb\x0bc d")] == [0, 0, 0, 0, 1, 1, 2]


def calls(f):
    """Python functions of the module that ``f`` calls, steps of generators included."""
    n = 0

    def count(frame, event, _):
        nonlocal n
        n += event == "call" and frame.f_code.co_filename == s.__file__

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def test_front_codes_and_merges_call_little_for_each_suffix():
    r = random.Random(7)
    owned = [sorted({bytes(r.choice(b"ab") for _ in range(40)) for _ in range(500)}) for _ in range(64)]
    n, coded = sum(map(len, owned)), []
    assert calls(lambda: coded.extend(map(s.front_code, owned))) < n // 10
    runs = [s.Run(lcps, [*map(len, ws)], tails) for (lcps, tails), ws in zip(coded, owned)]
    assert calls(lambda: [*s.merge(runs)]) < 7 * n


@pytest.mark.parametrize("size", [1 << 21, 100])
def test_front_code_is_exact(monkeypatch, size):
    monkeypatch.setattr(s, "_SLICE", size)
    r = random.Random(8)
    words = sorted({bytes(r.choice(b"\0a\xff") for _ in range(r.choice([0, 1, 5, 9, 60]))) for _ in range(4000)} | {b"a" * 3000, b"a" * 3001})
    lcps, tails = s.front_code(words)
    assert lcps == [0, *(len(os.path.commonprefix([a, b])) for a, b in zip(words, words[1:]))]
    assert tails == b"".join(w[n:] for w, n in zip(words, lcps)) and s.front_code([]) == ([], b"")
    for a, b in zip(words[::7], words[3::7]):
        n = len(os.path.commonprefix([a, b]))
        assert {s.common_prefix(a, b, known) for known in (0, n // 2, n)} == {n}


def test_whole_words_of_all_windows_at_once():
    r = random.Random(9)
    for _ in range(50):
        t = bytes(r.choice(b"ab \n\x0b\xc3") for _ in range(60))
        for least in (1, 2, 9, 60):
            starts = np.arange(len(t) - least + 1)
            want = [max(0, len((b"." + t[p : p + least] + b".").split()) - 2) for p in starts]
            assert s.whole_words(np.frombuffer(t, np.uint8), starts, least).tolist() == want
