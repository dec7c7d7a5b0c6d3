import os
import zlib

import numpy as np
import pytest

from tidestep.llm import quality

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = quality.op6_quality(spark, SF).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(truth[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in truth]
    y, s = np.array(held).T
    assert auc(y, s) > 0.95


def test_pairs_learn_an_interaction():
    r = np.random.default_rng(0)
    x = np.zeros((4000, len(quality.FEATURES)))
    x[:, :3] = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y, rounds=10)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95


def test_edges(spark, tmp_path):
    texts = [None, "", " \n", "a " * 200000, "Good text. And more of it.\nYes."] * 2
    spark.createDataFrame([(i, t, 1, 2.0) for i, t in enumerate(texts)] + [(None, "x", 1, 1.0)], "doc_id long, text string, y int, score_in double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0), (4, 1), (9, None), (77, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op6_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 1 and all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [(r.score, r.predicted) for r in quality.op6_quality(spark, str(tmp_path)).collect()] == [(0.5, 0)]


def test_scores_and_trees_against_a_plain_version():
    r = np.random.default_rng(2)
    x = r.random((300, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 3] * x[:, 5] > 0.9).astype(float)
    m = quality.fit(x, y, bins=12, rounds=15, n_pairs=3, pair_rounds=5)
    assert m.pairs
    for row, score in zip(x[:60], m.score(x[:60])):
        bins = [sum(1 for e in edges if e <= v) for edges, v in zip(m.edges, row)]
        z = m.intercept + sum(t[b] for t, b in zip(m.tables, bins)) + sum(t[m.coarse[i][bins[i]], m.coarse[j][bins[j]]] for (i, j), t in m.pairs.items())
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-12
    for _ in range(50):  # two leaves: the best of all cuts
        g, h = r.standard_normal(7), r.random(7)
        worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 2.0)
        gains = [worth(0, c) + worth(c, 7) - worth(0, 7) for c in range(1, 7)]
        c = int(np.argmax(gains)) + 1
        want = np.array([g[:c].sum() / (h[:c].sum() + 2)] * c + [g[c:].sum() / (h[c:].sum() + 2)] * (7 - c))
        if max(gains) > 1e-9:
            assert np.allclose(quality._tree(g, h, 2, 2.0), want)
        g, h = r.standard_normal((4, 5)), r.random((4, 5))
        part = lambda a: a[0].sum() ** 2 / (a[1].sum() + 2.0)
        cuts = {(i, j): sum(part((g[u, v], h[u, v])) for u in (slice(0, i), slice(i, 4)) for v in (slice(0, j), slice(j, 5))) for i in range(1, 4) for j in range(1, 5)}
        gain, out = quality._corner_tree(g, h, 2.0)
        i, j = max(cuts, key=cuts.get)
        assert abs(gain - (cuts[i, j] - part((g, h)))) < 1e-9
        assert abs(out[0, 0] - g[:i, :j].sum() / (h[:i, :j].sum() + 2)) < 1e-12 and abs(out[3, 4] - g[i:, j:].sum() / (h[i:, j:].sum() + 2)) < 1e-12


def test_empty_table_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert quality.op6_quality(spark, str(tmp_path)).count() == 0
    out = quality.score(spark.createDataFrame([(1, "x", "own")], "doc_id long, text string, score string"), quality.AdditiveModel())
    assert out.columns == ["doc_id", "text", "score", "score_"] and tuple(out.first())[2:] == ("own", 0.5)
