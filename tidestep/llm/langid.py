"""Operator 7: hierarchical language identification.

A text becomes hashed counts of the two- and three-byte sequences of its letters. One
linear support vector machine a family (that family against the rest) chooses the
language family; within it, one machine for each two languages votes. The machines are
fitted by dual coordinate descent on at most ``max_rows`` labelled rows, dealt evenly
over the languages and chosen by a hash of their id; the whole text of each row of the
corpus is read and scored in one pass without a shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0. So is
every text if there is nothing to learn from. With one language learned it is always
predicted. Repeated rows are scored each, rows with a null id too, and an empty table
gives an empty result. Ties between languages go to the first in alphabetical order.
Texts of any length are read whole, in slices. Extra columns pass through whatever
their names; added names that are there already get an underscore behind.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import table, with_text_columns

# Families of ISO 639-1 codes. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "ar am he mt",
    "sinitic": "zh yue",
}
_DIM = 4096
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.split("-")[0].lower() in codes.split()), lang)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of a text's hashed byte sequences, or None if it has no letter."""
    kept = _NOT_LETTERS.sub(" ", text.lower()) if text else ""
    if not any(map(str.isalpha, kept)):
        return None
    b = np.frombuffer(f" {kept} ".encode(), np.uint8)
    out = np.zeros(_DIM)
    step = 1 << 22  # long texts go through in slices that overlap by two bytes
    for at in range(0, max(1, len(b) - 2), step):
        x = b[at : at + step + 2].astype(np.uint32)
        two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] ^ (x[2:] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F))
        for h in (two[: len(three)], three):
            out += np.bincount((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=_DIM)
    out = np.sqrt(out)
    return (out / np.linalg.norm(out)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None, c: float = 10.0, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine with squared hinge loss; y is -1 or 1.

    ``rows`` are the rows of ``x`` to learn from (all by default) and ``y`` is theirs. ``x`` is
    read row by row and never copied, so all machines share one matrix.
    """
    rows = np.arange(len(x)) if rows is None else rows
    w, bias, a, r = np.zeros(x.shape[1]), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    extra = 1 / (2 * c)
    square = np.array([float(np.dot(v, v)) for v in (x[i].astype(np.float32) for i in rows)]) + 1 + extra
    for _ in range(rounds):
        most = 0.0
        for i in r.permutation(len(rows)):
            v = x[rows[i]].astype(np.float64)
            g = y[i] * (v @ w + bias) - 1 + extra * a[i]
            if g < 0 or a[i] > 0:
                new = max(0.0, a[i] - g / square[i])
                step = (new - a[i]) * y[i]
                v *= step
                w += v
                bias += step
                most = max(most, abs(new - a[i]))
                a[i] = new
        if most < 1e-3:
            break
    return np.append(w, bias)


@dataclass
class LanguageModel:
    """Learned languages and the weights of all machines, families first."""

    langs: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> LanguageModel:
        names = sorted(set(langs))
        if not names:
            return cls()
        m = cls.of(names)
        y, fam = np.array([names.index(v) for v in langs]), [family(v) for v in names]
        of = np.array([m.families.index(f) for f in fam])[y]
        rows = [linear_svm(x, np.where(of == f, 1, -1)) for f in range(len(m.families))] if len(m.families) > 1 else []
        for a, b in m.pairs:
            use = np.flatnonzero((y == a) | (y == b))
            rows.append(linear_svm(x, np.where(y[use] == a, 1, -1), use))
        return cls.of(names, rows)

    @classmethod
    def of(cls, names: list[str], rows: list[np.ndarray] = ()) -> LanguageModel:
        """The model of some languages (in alphabetical order) and the weights of its machines."""
        if not names:
            return cls()
        fam = [family(v) for v in names]
        pairs = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names)) if fam[a] == fam[b]]
        return cls(names, sorted(set(fam)), pairs, np.array(rows, np.float32).reshape(len(rows), _DIM + 1))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each feature row."""
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        nf = len(self.families) if len(self.families) > 1 else 0
        sure = 1 / (1 + np.exp(-4 * margin.astype(float)))
        by_family = sure[:, :nf] if nf else np.ones((len(x), 1))
        chosen = by_family.argmax(1)
        score = by_family.max(1) / by_family.sum(1)
        fam = np.array([self.families.index(family(v)) for v in self.langs])
        votes = np.zeros((len(x), len(self.langs)))
        peers = np.bincount(fam, minlength=len(self.families))[fam] - 1
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += sure[:, nf + k]
            votes[:, b] += 1 - sure[:, nf + k]
        votes = np.where(peers > 0, votes / np.maximum(peers, 1), 1.0)
        votes = np.where(fam[None, :] == chosen[:, None], votes, -1)
        best = votes.argmax(1)
        return [self.langs[i] for i in best], np.clip(score * votes.max(1), 0, 1)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 4000) -> LanguageModel:
    """A model from rows with a language, at most about ``max_rows`` of them (the bound of the sample)."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where("l IS NOT NULL")
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(max_rows).collect()}
    if not counts:
        return LanguageModel()
    each = max(1, max_rows // len(counts))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, each / n))])
    chance = F.pmod(F.xxhash64(F.lit("langid"), F.col("k")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(chance < F.coalesce(F.element_at(share, F.col("l")), F.lit(0.0))).select("t", "l").limit(2 * max_rows)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Half-precision rows: the one matrix that all machines read has at most 2 * max_rows rows of 8 KB.
        got = []
        for batch in batches:
            for t, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (f := features(t)) is not None:
                    got.append((v, f.astype(np.float16)))
        got.sort(key=lambda g: (g[0], zlib.crc32(g[1])))  # the same on every run
        langs, x = [v for v, _ in got], np.empty((len(got), _DIM), np.float16)
        for row in reversed(range(len(got))):
            x[row] = got.pop()[1]
        m = LanguageModel.fit(x, langs)
        weights = [] if m.weights is None else [w.tobytes() for w in m.weights]
        yield pa.record_batch([pa.array([m.langs], pa.list_(pa.string())), pa.array([weights], pa.list_(pa.binary()))], names=["langs", "weights"])

    # One task fits on the bounded sample; the driver gets the names and a row of weights for each machine.
    learned = picked.coalesce(1).mapInArrow(fit, "langs array<string>, weights array<binary>").collect()
    return LanguageModel.of(learned[0].langs, [np.frombuffer(w, np.float32) for w in learned[0].weights]) if learned else LanguageModel()


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs``, and the predicted language and its score for each row."""

    def make(texts: pa.Array) -> list[pa.Array]:
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if model.langs:
            for at in range(0, len(texts), 512):
                xs = [features(t.as_py()) for t in texts.slice(at, 512)]
                live = [i for i, x in enumerate(xs) if x is not None]
                if live:
                    found, sure = model.predict(np.array([xs[i] for i in live]))
                    for i, v, c in zip(live, found, sure.tolist(), strict=True):
                        langs[at + i], scores[at + i] = v, c
        return [pa.array(langs, pa.string()), pa.array(scores)]

    return with_text_columns(docs, text, make, [(names[0], "string"), (names[1], "double")])


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op7_langid(spark, sf_dir: str) -> DataFrame:
    """Contract of query 7 over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
