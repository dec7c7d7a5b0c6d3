import random
import re

import numpy as np
import pytest
import xxhash

from tidestep.llm import simhash


def brute_fp(text, words=3):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = {i: brute_fp(t) for i, t in rows}
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_code_is_perfect():
    v = np.arange(1 << 23)
    assert (np.bincount(simhash.codeword(v), minlength=4096) == 2048).all()


def test_keys_find_every_near_pair():
    r = random.Random(3)
    for _ in range(3000):
        u = r.getrandbits(64)
        v = u
        for b in r.sample(range(64), r.randint(1, 3)):
            v ^= 1 << b
        fps = np.array([u, v], np.uint64).view(np.int64)
        key, fp, probe = simhash.golay_keys(fps)
        index = set(key[(fp == fps[0]) & ~probe].tolist())
        assert index & set(key[(fp == fps[1]) & probe].tolist())


@pytest.mark.parametrize("small,block", [(32, 1024), (1, 3)])
def test_links_keep_components(spark, small, block):
    r = random.Random(small)
    fps = set()
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 40])):
            fps.add(x)
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.node: r.root for r in simhash.components(simhash.links(nodes, small=small, block=block)).collect()}
    assert {f: got.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_query_against_brute_force(spark, tmp_path):
    r, rows = random.Random(5), []
    vocab = ["w%d" % i for i in range(500)] + ["Été", "ÀB", "Xy"]
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.choice([0, 1, 2, 3, 40, 600]))]
        rows.append((len(rows), r.choice([" ", "\n", "\t "]).join(w)))
        for _ in range(r.choice([0, 0, 1, 5])):
            v = list(w)
            for _ in range(r.randint(0, 3)):
                if v:
                    v[r.randrange(len(v))] = r.choice(vocab)
            rows.append((len(rows), " ".join(v).upper() if r.random() < 0.3 else " ".join(v)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n"), (len(rows) + 3, "long " * 50000)]
    spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, fp int, key string, component_id int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, str(tmp_path)).collect()}
    assert got == brute_components(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert simhash.op10_simhash(spark, str(tmp_path)).count() == 0


def test_components_end_with_the_first_stars(spark, monkeypatch):
    import random

    from tidestep.llm import components

    written, keep = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: written.append(name) or keep(df, name))
    stars = [(10 * s, 10 * s + k) for s in range(3) for k in range(1, 5)]
    r = random.Random(3)
    nodes = r.sample(range(-(1 << 40), 1 << 40), 200)
    chains = [(nodes[i], nodes[i + 1]) for i in range(199) if i % 40 != 39]
    cliques = [(a, b) for s in range(0, 200, 10) for a in nodes[s : s + 5] for b in nodes[s : s + 5]]
    for pairs in (stars, chains, cliques, [(1, 1)], []):
        edges = [*pairs, *((b, a) for a, b in pairs[::3]), *pairs[::5]]
        least = {x: x for e in edges for x in e if e[0] != e[1]}
        for _ in least:
            for a, b in edges:
                if a != b:
                    least[a] = least[b] = min(least[a], least[b])
        got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert len(got) == len(least) and {x.node: x.root for x in got} == least
        if pairs is stars:
            assert written == ["edges"]
