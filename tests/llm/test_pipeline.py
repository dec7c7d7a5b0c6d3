"""The pipeline against a brute-force version of its stages."""

import hashlib
import os
import random
import sys
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_simhash import brute_components

SPACE = " \t\n\x0b\x0c\r"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(docs, items):
    docs = {i: t for i, t in docs.items() if t and any(map(str.isalpha, t))}
    keys = {i: [lower(x.strip(SPACE)) for x in t.split("\n")] for i, t in docs.items()}
    df = Counter(k for ks in keys.values() for k in {*ks} if k)
    docs = {i: "\n".join(x for x, k in zip(t.split("\n"), keys[i]) if df[k] < 10) for i, t in docs.items()}
    docs = {i: docs[i] for i, (_, c) in brute_components(docs.items()).items() if c == i}
    docs = {i: t for i, t in docs.items() if not any(x in t for x in items)}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    ids = {i: tok.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {(i, len(x), sha(",".join(map(str, x))), sha(tok.decode(x, skip_special_tokens=False))) for i, x in ids.items()}


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    r, d = random.Random(8), str(tmp_path_factory.mktemp("pipeline"))
    make = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(make() for _ in range(n))
    items = [text(r.randint(15, 50)) + "." for _ in range(12)]
    common = [text(5) for _ in range(3)]
    rows = [None, "", "12 !!", "\n\n"]
    for i in range(120):
        t = text(r.randint(30, 300))
        if i % 3 == 0:
            t += "\n " + r.choice(common).upper() + " \n" + text(20)
        if i % 11 == 0:
            t = t + "\n" + r.choice(items) + "\n" + text(10)
        rows.append(t)
        if i % 9 == 0:
            rows += [t, t + " " + make()]
    spark.createDataFrame([(i, t, r.choice(["en", "de", None]), "s", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(enumerate(rows)), items


def test_against_brute_force(spark, tables):
    d, docs, items = tables
    got = [tuple(r) for r in corpus_pipeline.run(spark, d).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert len(got) == len({*got}) and {*got} == brute(docs, items)


def test_stages_keep_the_columns(spark, tables):
    d, *_ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns


def test_repeated_rows_nulls_and_extra_columns(spark, tmp_path):
    rows = [(1, "some words here to keep", "en", "s", 1, "x")] * 3 + [(None, "other words that stay here", None, None, None, None), (None, None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 1]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names(spark, tmp_path):
    names = ["dropped", "_k", "_h", "_hash", "_id", "_none", "_lang", "_leaks", "_text_hash", "leaks", "language", "sure", "row", "none", "id", "h", "c0", "c1", "_n_lines", "text_in", "key", "ids", "decoded"]
    rows = [(i, "some words that stay here %d\nsame line" % (i // 2), None if i % 2 else "en", "s", 1, *("own",) * len(names)) for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "unseen words of a benchmark item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns[5:] == names and all(set(r[5:]) == {"own"} for r in docs.collect())
    got = docs.collect()
    assert sorted(r.doc_id for r in got) == [*range(0, 24, 2)] and all(r.lang == "en" and "same line" not in r.text and r.n_chars == len(r.text) for r in got)
    assert {r.doc_id for r in corpus_pipeline.encoded(spark, docs, str(tmp_path)).collect()} == {*range(0, 24, 2)}


def test_a_missing_language_is_filled_and_ids_win_over_nulls(spark, tmp_path):
    texts = {"en": "the cat and the dog in the house of the man ", "de": "der hund und die katze in dem haus des mannes "}
    rows = [(i, texts[v] * 3 + str(i), v, "s", 1) for i in range(30) for v in texts] + [(100, texts["de"] * 4, None, "s", 1), (None, "wholly other words " * 9, "en", "s", 1), (7, "wholly other words " * 9, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.known_language(spark, docs, str(tmp_path)).collect()
    assert len(out) == len(rows) and [r.lang for r in out if r.doc_id == 100] == ["de"]
    kept = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).where("text LIKE 'wholly%'").collect()
    assert [r.doc_id for r in kept] == [7]
