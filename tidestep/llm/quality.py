"""Operator 6: text quality by a generalised additive model with pairwise interactions.

Each text becomes a few dozen numbers (shares of kinds of characters, repetition of
words, word pairs and lines, shapes of lines). Cyclic boosting fits shallow trees, one
feature at a time and round after round, and adds them into one lookup table for each
feature; what is left is fitted in the same way by trees on the pairs of features with
the largest gain. A score is a sum of table entries, found by bin numbers.

The model is fitted on at most about ``max_rows`` labelled rows (a documented bound,
chosen by a hash of the key); every row of the corpus is scored from its whole text,
in one pass without a shuffle.

Defined results: null, empty and white-space texts are scored by their features, which
are zero. If no label can be learned from, every score is the share of label 1, or 0.5
without any label. Repeated rows are scored each, rows with a null key too (no label is
theirs), and equal texts have equal scores. An empty table gives an empty result. Extra
columns pass through whatever their names; an added name that is there already gets an
underscore behind. Texts of any length are read whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidestep.llm.common import table, with_text_columns

FEATURES = (
    "log_words", "letters", "upper", "digits", "spaces", "marks", "pipes", "commas_stops", "non_ascii",
    "mean_word", "long_words", "one_letter", "distinct_words", "distinct_pairs", "top_word", "same_next",
    "mean_line", "distinct_lines", "ended_lines", "title_words", "marked_words",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_KINDS = np.stack(
    [
        _class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)])),
        _class(bytes(range(65, 91))),
        _class(b"0123456789"),
        _class(b" \t\n\x0b\x0c\r"),
        _class(b"!#$%&*+/<=>?@[\\]^_`{}~"),
        _class(b"|"),
        _class(b",.;:"),
        _class(bytes(range(128, 256))),
    ],
    axis=1,
)


def features(text: str | None) -> np.ndarray:
    """The numbers of one text."""
    out = np.zeros(len(FEATURES))
    words = text.split() if text else []
    if not words:
        return out
    raw = text.encode()
    out[1:9] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS / len(raw)
    n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    out[0] = np.log1p(n)
    out[9] = sizes.mean()
    out[10] = (sizes > 14).mean()
    out[11] = (sizes == 1).mean()
    out[12] = len(seen) / n
    out[13] = len({*zip(words, words[1:], strict=False)}) / max(1, n - 1)
    out[14] = max(seen.values()) / n
    out[15] = sum(map(eq, words, words[1:])) / n
    out[16] = np.log1p(n / max(1, len(lines)))
    out[17] = len({*lines}) / max(1, len(lines))
    out[18] = sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines))
    out[19] = sum(c for w, c in seen.items() if w.istitle()) / n
    out[20] = sum(c for w, c in seen.items() if not w[-1].isalnum() and w[-1] not in ",.;:") / n
    return out


@dataclass
class AdditiveModel:
    """Intercept, the bin edges of each feature, a table for each, and tables for pairs on coarse bins."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each feature row: bin additions."""
        z = np.full(len(x), self.intercept)
        if self.edges:
            bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
            for b, t in zip(bins, self.tables, strict=True):
                z += t[b]
            for (i, j), t in self.pairs.items():
                z += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-z))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, penalty: float) -> np.ndarray:
    """The step of a shallow tree on the ordered bins of one feature, from sums of gradient and weight."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + penalty)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = worth(a, c) + worth(c, b) - worth(a, b)
                best = max(best, (float(gain.max()), int(c[gain.argmax()])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + penalty)
    return out


def _corner_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Gain and step of the best cut of a pair's grid into four."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quarter = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    qg, qh = quarter(cg), quarter(ch)
    gain = sum(a * a / (b + penalty) for a, b in zip(qg, qh, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + penalty)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(g)
    parts = [a[i, j] / (b[i, j] + penalty) for a, b in zip(qg, qh, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = parts
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, grid: int = 8, rounds: int = 120, n_pairs: int = 12, pair_rounds: int = 40, rate: float = 0.15, penalty: float = 2.0) -> AdditiveModel:
    """Cyclic boosting of logistic loss; labels are 0 and 1."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    m = AdditiveModel(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return m
    for j in range(x.shape[1]):
        m.edges.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])))
        n = len(m.edges[j]) + 1
        m.tables.append(np.zeros(n))
        m.coarse.append(np.arange(n) * min(grid, n) // n)
    b = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.edges)]
    z = np.full(len(y), m.intercept)

    def sums(index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.bincount(index, y - p, n), np.bincount(index, p * (1 - p), n)

    for _ in range(rounds):
        for j, t in enumerate(m.tables):
            step = rate * _tree(*sums(b[j], len(t)), 3, penalty)
            t += step
            z += step[b[j]]
    sides = [int(c[-1]) + 1 for c in m.coarse]
    at = lambda i, j: m.coarse[i][b[i]] * sides[j] + m.coarse[j][b[j]]

    def corner(i: int, j: int) -> tuple[float, np.ndarray]:
        g, h = sums(at(i, j), sides[i] * sides[j])
        return _corner_tree(g.reshape(sides[i], -1), h.reshape(sides[i], -1), penalty)

    gains = sorted(((corner(i, j)[0], i, j) for i in range(len(sides)) for j in range(i)), reverse=True)
    m.pairs = {(i, j): np.zeros((sides[i], sides[j])) for gain, i, j in gains[:n_pairs] if gain > 0}
    for _ in range(pair_rounds):
        for (i, j), t in m.pairs.items():
            step = rate * corner(i, j)[1]
            t += step
            z += step.ravel()[at(i, j)]
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", max_rows: int = 8000) -> AdditiveModel:
    """A model from rows with a label, at most about ``max_rows`` of them (the bound of the sample)."""
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)")
    marked = marked.groupBy("k").agg(F.max("y").alias("y"))
    n = marked.count()
    chance = F.pmod(F.xxhash64(F.lit("quality"), F.col("k")), F.lit(1 << 30)) / float(1 << 30)
    picked = marked.where(chance < min(1.0, max_rows / max(1, n))).limit(2 * max_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(picked), "k")  # of 2 * max_rows rows at most

    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([features(t).tolist() for t in texts.to_pylist()], pa.list_(pa.float64()))]

    got = with_text_columns(rows, "t", make, [("x", "array<double>")]).groupBy("k").agg(F.max("y").alias("y"), F.min("x").alias("x"))
    got = sorted((tuple(r.x), r.y) for r in got.limit(2 * max_rows).collect())
    x = np.array([v for v, _ in got]).reshape(len(got), len(FEATURES))
    return fit(x, np.array([v for _, v in got], float))


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each row."""

    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(model.score(np.array([features(t) for t in texts.to_pylist()]).reshape(len(texts), len(FEATURES))))]

    return with_text_columns(docs, text, make, [(name, "double")])


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Contract of query 6 over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
