import os
import zlib

import pytest

from tidestep.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = langid.op7_langid(spark, SF).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) / len(held) > 0.97


def test_edges(spark, tmp_path):
    rows = [(i, t, l, "s", 1.0) for i, (t, l) in enumerate([(None, "en"), ("", None), ("123 $$", "de"), ("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de"), ("le chat et le chien " * 9, "fr"), ("x " * 300000, None)] * 3)]
    rows.append((None, "the dog", "en", "s", 1.0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, l string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op7_langid(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[0].lang_pred == by[1].lang_pred == by[2].lang_pred == "und"
    assert by[3].lang_pred == "en" and by[4].lang_pred == "de" and by[5].lang_pred == "fr"


def test_nothing_to_learn(spark, tmp_path):
    spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.lang_pred for r in langid.op7_langid(spark, str(tmp_path)).collect()] == ["und"]


def test_votes_against_a_plain_version():
    import math

    import numpy as np

    r = np.random.default_rng(4)
    langs = ["de", "en", "es", "fr", "it", "pl"]
    centre = r.random((6, langid._DIM)) < 0.01
    x = np.array([np.where(centre[i % 6], 1.0, 0.0) + 0.3 * (r.random(langid._DIM) < 0.01) for i in range(120)], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = langid.LanguageModel.fit(x.astype(np.float16), [langs[i % 6] for i in range(120)])
    got, scores = m.predict(x)
    for row, lang, score in zip(x, got, scores):
        sure = [1 / (1 + math.exp(-4 * (sum(float(a) * float(b) for a, b in zip(row, w[:-1])) + float(w[-1])))) for w in m.weights]
        fams = sure[: len(m.families)]
        best = max(range(len(fams)), key=lambda f: (fams[f], -f))
        peers = [v for v in langs if langid.family(v) == m.families[best]]
        votes = {v: [] for v in peers}
        for (a, b), p in zip(m.pairs, sure[len(fams) :]):
            if langs[a] in votes:
                votes[langs[a]].append(p)
                votes[langs[b]].append(1 - p)
        mean = {v: sum(p) / len(p) if p else 1.0 for v, p in votes.items()}
        want = max(peers, key=lambda v: (mean[v], -peers.index(v)))
        assert lang == want and abs(score - fams[best] / sum(fams) * mean[want]) < 1e-4
    assert got == [langs[i % 6] for i in range(120)]


def test_machine_against_a_plain_gradient():
    import numpy as np

    r = np.random.default_rng(5)
    x = r.standard_normal((60, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 * r.standard_normal(60) > 0.2, 1, -1)
    w = langid.linear_svm(x, y, c=1.0, rounds=400)
    full, plain = np.c_[x, np.ones(60)].astype(float), np.zeros(6)
    for _ in range(20000):  # descent on the same loss, squared hinge with the bias among the weights
        gap = np.maximum(0, 1 - y * (full @ plain))
        plain -= 2e-3 * (plain - 2 * full.T @ (y * gap))
    assert np.allclose(w, plain, atol=5e-3)
    rows = np.arange(0, 60, 2)
    assert np.allclose(langid.linear_svm(x, y[rows], rows), langid.linear_svm(x[rows], y[rows]))


def test_empty_table_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert langid.op7_langid(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, "the cat", "en", "x", 2.0)], "doc_id long, text string, lang string, lang_pred string, score double")
    out = langid.identify(docs, langid.train(docs))
    assert out.columns == [*docs.columns, "lang_pred_", "score_"] and [tuple(r)[3:6] for r in out.collect()] == [("x", 2.0, "en")]


def test_machines_are_fitted_in_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), (None, "it"), ("12", "it")])], "doc_id long, text string, lang string")
    fit, driver = langid.LanguageModel.fit.__func__, os.getpid()

    def in_a_task(cls, x, langs):
        assert os.getpid() != driver, "the driver gets the sample"
        return fit(cls, x, langs)

    monkeypatch.setattr(langid.LanguageModel, "fit", classmethod(in_a_task))
    m = langid.train(docs)
    assert (m.langs, m.families, m.pairs, m.weights.shape) == (["de", "en", "fr"], ["germanic", "romance"], [(0, 1)], (3, langid._DIM + 1))
    assert [r.lang_pred for r in langid.identify(docs, m).orderBy("doc_id").collect()] == ["en", "de", "fr", "und", "und"]
    one = langid.train(docs.where("doc_id = 0"))
    assert (one.langs, one.weights.shape) == (["en"], (0, langid._DIM + 1))
    assert langid.train(docs.where("doc_id > 2")).langs == []
