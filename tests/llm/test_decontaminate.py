import os
import random
import re

import numpy as np
import pytest

from tidestep.llm import decontaminate as d

SF = "/root/testdata/sf0.01"


def test_word_hashes():
    texts = ["Ab c-d éÉ 1x", "", "ab", "C"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts[:-1])])
    h, at = d.words(raw, bounds)
    assert len(h) == 7 and h[0] == h[5] and h[1] == h[6] and len(set(h.tolist())) == 5
    find = d._lookup(np.unique(h[:3]))
    assert (find(h) >= 0).tolist() == [True, True, True, False, False, True, True]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randrange(5) for _ in range(r.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert d.common_subsequence(a, b) == t[-1][-1]


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_finds_each_exact_leak(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {(i, k) for i, t in docs.items() for k, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in d.op9_decontaminate(spark, SF).collect()}
    assert want and want <= got
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    for i, k in got - want:  # what is found besides shares most of its words
        assert len({*words(items[k])} & {*words(docs[i])}) >= 0.5 * len({*words(items[k])})


def corpus(seed):
    r = random.Random(seed)
    make = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    common = [make() for _ in range(40)]
    word = lambda: r.choice(common) if r.random() < 0.5 else make()
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    items = [sentence(r.randint(8, 20)) + " " + sentence(r.randint(5, 30)) for _ in range(30)]
    docs = [sentence(r.randint(0, 400)) for _ in range(300)]
    return r, word, items, docs


def test_paraphrases_and_clean_documents(spark):
    r, word, items, docs = corpus(3)
    want = set()
    for i in range(0, 300, 5):
        k = r.randrange(len(items))
        w = items[k].split()
        for _ in range(len(w) // 8):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.5:
            w.insert(r.randrange(len(w)), word())
        cut = r.randrange(len(docs[i]) + 1)
        docs[i] = docs[i][:cut] + " " + " ".join(w).upper() + "\n" + docs[i][cut:]
        want.add((i, k))
    df = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string").repartition(4)
    model = d.train(df, spark.createDataFrame([*enumerate(items)], "item_id long, text string"))
    got = {(x.doc_id, model.items[y.item]) for x in d.leaks(df, model).collect() for y in x.leaks}
    assert len(want & got) >= 0.95 * len(want) and len(got - want) <= 2


def test_the_latent_space_alone_finds_paraphrases_and_prunes(spark):
    r, word, items, docs = corpus(11)
    want = set()
    for i in range(0, 300, 3):
        k = r.randrange(len(items))
        w = [word() if r.random() < 0.12 else x for x in items[k].split()]
        host = docs[i].split()
        cut = r.randrange(len(host) + 1)
        docs[i] = " ".join([*host[:cut], *w, *host[cut:]])
        want.add((i, k))
    df = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string").repartition(4)
    model = d.train(df, spark.createDataFrame([*enumerate(items)], "item_id long, text string"))
    found = lambda **how: {(x.doc_id, model.items[y.item]) for x in d.leaks(df, model, **how).collect() for y in x.leaks}
    every = found(least_cosine=-2.0) & want
    assert len(found(verbatim=False) & want) >= 0.9 * len(every) and len(every) >= 0.9 * len(want)
    # Of all pairs of a passage and a piece, few are candidates.
    import pyarrow as pa

    b = d._blocks(pa.array(docs), d._lookup(model.vocabulary))
    use = model.content[b.term]
    x = d._by_group(b.block[use], b.term[use], model.latent, len(b.text_of))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    assert (x @ model.targets.T >= 0.15).mean() < 0.3


def test_randomised_svd_against_an_exact_one():
    r = np.random.default_rng(3)
    a = r.standard_normal((400, 12)) @ np.diag(0.6 ** np.arange(12)) @ r.standard_normal((12, 90)) + 0.001 * r.standard_normal((400, 90))
    s = d._random(90, 20).astype(float)
    v = d.randomised_svd(a.T @ (a @ s), s, 8)
    exact = np.linalg.svd(a, full_matrices=False)[2][:8].T
    assert v.shape == (90, 8) and np.allclose(v.T @ v, np.eye(8), atol=1e-8)
    assert np.linalg.svd(exact.T @ v)[1].min() > 0.999  # the same space
    assert np.linalg.norm(a @ v) >= 0.9999 * np.linalg.norm(a @ exact)


def test_every_verbatim_item_at_every_offset(spark):
    r, word, items, docs = corpus(5)
    # Words that the latent space gives no weight: they occur in none of the documents that it comes from.
    rare = lambda n: " ".join(f"q{r.randrange(10**6)}x" for _ in range(n)) + "."
    known = len(docs)
    items = items[:3] + [rare(n) for n in (15, 20, 30, 48)]
    want = set()
    for offset in range(64):
        for k in range(3, len(items)):
            want.add((len(docs), k))
            docs.append(" ".join([word() for _ in range(offset)] + [items[k]] + [word() for _ in range(70)]))
    df = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string").repartition(4)
    model = d.train(df.where(f"doc_id < {known}"), spark.createDataFrame([*enumerate(items)], "item_id long, text string"))
    got = {(x.doc_id, model.items[y.item]) for x in d.leaks(df, model).collect() for y in x.leaks}
    assert want <= got


def test_long_pieces_and_plain_answers(spark):
    r, word, _, docs = corpus(6)
    rare = lambda n: [f"q{r.randrange(10**6)}x" for _ in range(n)]
    docs = [t + " " + " ".join(["so it was then"] * 20) for t in docs]  # stop words
    items = [rare(48) for _ in range(6)] + [[*rare(12)[:-1], "end.", "So", "it", "was."] for _ in range(6)]
    want = set()
    for offset in range(32):
        for k, w in enumerate(items):
            if k < 3:  # 14 of 48 words changed, spread
                w = [f"z{i}" if i % 7 in (2, 5) else x for i, x in enumerate(w)]
            elif k < 6:  # a word in after each second one, and one in ten changed
                w = [y for i, x in enumerate(w) for y in ([f"z{i}" if i % 10 == 4 else x] + [f"y{i}"] * (i % 2))]
            else:  # six of its twelve content words and the answer
                w = [*(f"z{i}" if i % 2 else x for i, x in enumerate(w[:-3])), *w[-3:]]
            want.add((len(docs), k))
            docs.append(" ".join([word() for _ in range(offset)] + w + [word() for _ in range(100)]))
    df = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    model = d.train(df, bench)
    got = {(x.doc_id, model.items[y.item]) for x in d.leaks(df, model).collect() for y in x.leaks}
    missed = [(i, k) for i, k in want - got]
    assert not missed and not got - want


def test_edges(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda."
    rows = [(0, None), (1, ""), (2, "!!"), (3, item), (4, item), (5, "word " * 400000 + item), (None, item), (6, "alpha " * 90)]
    spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, item int, item_id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item, 2), (8, None, 2), (9, "", 2), (10, item, 2)], "item_id long, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = d.op9_decontaminate(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in got) == sorted((i is None, i or 0, k) for i in (3, 4, 5, None) for k in (7, 10))
    assert all(r.answer and r.common == 1 for r in got)


def test_empty_tables(spark, tmp_path):
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        spark.createDataFrame([], f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    assert d.op9_decontaminate(spark, str(tmp_path)).count() == 0
