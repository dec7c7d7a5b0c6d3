"""Operators that SQL can express, against that SQL on the small tables and on edge cases."""

import os

import pytest
from oracle import compare

from tidestep.llm import licenses, line_dedup, queries, topk

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


EDGE = [None, "", "\n", "a\n\n b \x0bc\r\n", " Spam LINE \n", "spam line", "ÉCOLE", "école", "x" * 200000 + "\nspam line\n" * 3000, "(c) 2020 Me\nReleased under the MIT Licence.", "released   UNDER the mit license", licenses.KNOWN["MIT"], "Copyright (c) 1999 A\n\n" + licenses.KNOWN["MIT"].replace(" ", "\n")]


def documents(spark, tmp_path, texts):
    rows = [(i, t, "d", 1, "k") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, digest string, h1 int, k string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("copies", [0, 1, 12])
def test_texts_on_edges(spark, tmp_path, copies):
    d = documents(spark, tmp_path, EDGE * copies)
    for name in ("op1_licenses", "op3_passages", "op3_substring_dedup", "op5_line_dedup"):
        assert compare(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], d) == copies * len(EDGE)


def test_licence_is_found(spark, tmp_path):
    got = {r.doc_id: r for r in licenses.op1_licenses(spark, documents(spark, tmp_path, EDGE)).collect()}
    assert got[11].license_id == got[12].license_id == "MIT"
    assert got[9].license_id == got[10].license_id == "MIT-notice" and got[9].n_notices == 1
    assert got[0].license_id is None


def test_keep_first_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i, "same\nown %d\nsame" % i) for i in range(12)] + [(3, "same\nown 3\nsame"), (None, "same")], "doc_id long, text string")
    out = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs, keep_first=True)).collect()
    assert len(out) == 14
    texts = {(r.doc_id, r.text) for r in out}
    assert (3, "own 3") in texts and (5, "own 5") in texts
    assert sum("same" in r.text for r in out) == 1


def test_topk_on_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (50, [0.5, -0.25]), (100, None), (150, [0.0, 0.0]), (200, [-1.0, 2.0])]
    spark.createDataFrame([(i, v, 7, "q") for i, v in rows], "vec_id long, embedding array<float>, score int, q string").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert compare(spark, "op4", topk.op4_topk, topk.OP4_SQL, str(tmp_path)) == 20


def test_topk_in_small_blocks(spark):
    import numpy as np

    r = np.random.default_rng(1)
    e = r.integers(-3, 4, (300, 7))
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(e)] + [(5, [int(x) for x in e[5]]), (None, [1])], "vec_id long, v array<long>")
    from pyspark.sql import functions as F

    got = {}
    for x in topk.topk_inner(df, F.col("vec_id") % 10 == 0, k=4, block=37, query_block=11).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    # A row that shares its id with another is a candidate too.
    ids, rows = [*range(300), 5], np.vstack([e, e[5:6]])
    s = rows @ rows.T
    for q in range(0, 300, 10):
        want = sorted((-int(s[q, c]), ids[c]) for c in range(301) if c != q)[:4]
        assert sorted(got[q]) == [(k + 1, c, -v) for k, (v, c) in enumerate(want)]


def test_topk_of_rows_that_share_an_id(spark, tmp_path):
    rows = [(50, [1.0, 0.5]), (50, [0.5, 1.0]), (50, [0.5, 1.0]), (7, [2.0, 2.0]), (None, [9.0, 9.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert compare(spark, "op4", topk.op4_topk, topk.OP4_SQL, str(tmp_path)) == 9


def test_topk_without_vectors(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert topk.op4_topk(spark, str(tmp_path)).count() == 0


# Licence lines as the documents and other texts write them, and the ids they state.
LICENSE_LINES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under CC BY-SA 3.0": "CC-BY-SA-3.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "CC-BY-NC-ND-4.0",
    "// SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "This software is released under the 3-clause BSD license.": "BSD-3-Clause",
}


def test_license_lines_of_a_fixture(spark, tmp_path):
    texts = [f"Some words.\n{x}\nmore" for x in LICENSE_LINES]
    got = {r.doc_id: r for r in licenses.op1_licenses(spark, documents(spark, tmp_path, texts)).collect()}
    for i, spdx in enumerate(LICENSE_LINES.values()):
        assert got[i].n_notices == 1 and got[i].notices.startswith(f"{spdx}-notice"), texts[i]


def test_full_licenses(spark, tmp_path):
    zlib = """Copyright (c) 2001 A B
    This software is provided 'as-is', without any express or implied warranty. In no
    event will the authors be held liable for any damages arising from the use of this software.
    Permission is granted to anyone to use this software for any purpose, including commercial
    applications, and to alter it and redistribute it freely, subject to the following restrictions:
    1. The origin of this software must not be misrepresented; you must not claim that you wrote the
       original software. If you use this software in a product, an acknowledgement in the product
       documentation would be appreciated but is not required.
    2. Altered source versions must be plainly marked as such, and must not be misrepresented as
       being the original software.
    3. This notice may not be removed or altered from any source distribution."""
    ids = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"]
    texts = [zlib, *("Copyright (c) 2020 X\n" + licenses.KNOWN[i].upper().replace("\n\n", "\n \n") for i in ids)]
    got = {r.doc_id: r.license_id for r in licenses.op1_licenses(spark, documents(spark, tmp_path, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == ["Zlib", *ids]


def test_passage_of_short_lines_keeps_one_copy(spark, tmp_path):
    verse = "\n".join(f"five words of line {i}" for i in range(12))
    texts = [f"own {i}\n{verse}\nend {i}" for i in range(3)]
    d = documents(spark, tmp_path, texts)
    assert compare(spark, "op3_all_lines", queries.QUERIES["op3_all_lines"], queries.ORACLE_SQL["op3_all_lines"], d) == 3
    assert {r.doc_id: r.n_removed for r in queries.QUERIES["op3_all_lines"](spark, d).collect()} == {0: 0, 1: 12, 2: 12}


def test_passages_within_lines_are_found_and_short_ones_left_alone(spark, tmp_path):
    passage = "Eleven words make up the first of these sentences right here. And then there is one more of them.\nIs the next line a part of it? Yes, it is, and it has enough words to count. One more sentence of seven words here."
    common = "A common line of nine words that many share"
    texts = [f"Own start {i} {passage} own end {i}.\n{common}\nThe rest is {i}." for i in range(3)] + [f"Alone {i}.\n{common}" for i in range(3)] + [passage.replace(". ", " .  ").upper(), None, ""]
    d = documents(spark, tmp_path, texts)
    assert compare(spark, "op3_passages", queries.QUERIES["op3_passages"], queries.ORACLE_SQL["op3_passages"], d) == len(texts)
    got = {r.doc_id: r for r in queries.QUERIES["op3_passages"](spark, d).collect()}
    assert [got[i].has_repeat for i in range(9)] == [True] * 3 + [False] * 3 + [True, False, False]
    assert [got[i].n_removed for i in range(9)] == [0, 4, 4, 0, 0, 0, 4, 0, 0]


def test_passages_keep_extra_columns_and_the_earliest(spark):
    from tidestep.llm import substring_dedup

    t = " ".join(f"Sentence {i} has six words here." for i in range(8))
    names = ["_removed", "_n_units", "_h", "k", "h", "note", "both", "own_hash", "text_in"]
    docs = spark.createDataFrame([(i, r, t + f" End of {i}.", *("own",) * len(names)) for i, r in ((1, 5), (2, 3), (3, 4))] + [(None, 9, t, *("own",) * len(names))], "doc_id long, r int, text string, " + ", ".join(f"`{n}` string" for n in names))
    for rank, first in (("r", 2), (None, None)):
        out = substring_dedup.passages(docs, rank=rank)
        assert out.columns[: 3 + len(names)] == docs.columns and len(out.columns) == 6 + len(names)
        rows = {x[0]: x for x in out.collect()}
        assert all(x[3:12] == ("own",) * 9 for x in rows.values())
        for k, x in rows.items():
            assert x[2].startswith(t) if k == first else "Sentence" not in x[2]
            for s in x[12]:
                assert "Sentence" in (t + f" End of {k}.")[s.start : s.stop]
    assert substring_dedup.dedup(docs).columns[:12] == docs.columns
    assert substring_dedup.passages(docs.limit(0)).count() == 0
