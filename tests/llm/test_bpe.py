import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidestep.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
EDGE = [None, "", " ", "\n\n  x", "a" * 3000, "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "don't I'LL we've", "   x \x1c\x1d y", "é́ 日本語 🙂🙂", "  \t\t lots\r\n of   space  ", "12345678901234567890", "!!!???...", "﻿bom", "x\x00y", " ᠎​ z\x85q"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_equals_library(library):
    r, own = random.Random(1), bpe.ByteBpe(PATH)
    texts = [t or "" for t in EDGE]
    for _ in range(1500):
        texts.append("".join(r.choice(["the", "ing", " ", "  ", "\n", "a", "A", "é", "ß", "7", "99", "'s", "'", "-", "==", "日", "aaaa", "́", "🙂", "tion", "\t", "<|", "|>", "endoftext", "<|endoftext|>"]) for _ in range(r.randint(0, 40))))
        texts.append("".join(chr(r.choice([r.randint(1, 255), r.randint(1, 0x3000), r.randint(97, 122)])) for _ in range(r.randint(0, 30))))
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, repr(t)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == t


def test_query_on_edges(spark, tmp_path, library):
    rows = [(i, t, "x", "y") for i, t in enumerate([*EDGE, *EDGE])]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, key string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in bpe.op8_bpe(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert bpe.op8_bpe(spark, str(tmp_path)).count() == 0
