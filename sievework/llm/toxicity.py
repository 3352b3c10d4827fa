"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from document labels."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import text_batches

TRAIN_ROWS, FEATURES, LEAST_DOCS, MOST = 5_000, 3072, 4, 1 << 20
_SENTENCE = re.compile(r"(?<=[.!?])[\s]+|\n+")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str | None) -> list[str]:
    """The non-blank sentences of a text: cut after . ! ? before white space, and at line ends."""
    return [s for s in _SENTENCE.split(text or "") if s and not s.isspace()]


def features_of(word: str) -> tuple[str, ...]:
    """What a lower-case word contributes: itself and its first four and five letters, which catch inflected forms."""
    return (word, f"{word[:4]}*", f"{word[:5]}**")


class Model:
    """Sentence model: logit = bias + the weights of the features of its distinct words; prior scores texts without a sentence."""

    def __init__(self, weights: dict[str, float], bias: float, prior: float):
        self.weights, self.bias, self.prior, self._memo = weights, bias, prior, {}

    def __getstate__(self):
        return self.weights, self.bias, self.prior

    def __setstate__(self, state):
        self.__init__(*state)

    def word(self, w: str) -> float:
        x = self._memo.get(w)
        if x is None:
            if len(self._memo) >= 1 << 17:  # bounded memory
                self._memo.clear()
            x = self._memo[w] = sum(self.weights.get(f, 0.0) for f in features_of(w))
        return x

    def logits(self, text: str | None) -> np.ndarray:
        """One for each sentence."""
        parts = sentences(text)
        hot = {w: x for w in set(_WORD.findall((text or "").lower())) if (x := self.word(w))}
        if not hot:
            return np.full(len(parts), self.bias)
        return np.array([self.bias + sum(hot[w] for w in hot.keys() & set(_WORD.findall(s.lower()))) for s in parts])

    def score(self, text: str | None) -> float:
        """P(toxic) = 1 - the product of (1 - p) over the sentences."""
        z = self.logits(text)
        return float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else self.prior

    def offending(self, text: str | None, least: float = 0.5) -> list[tuple[int, str, float]]:
        """The sentences that score at least so much: (position, sentence, score)."""
        p = 1 / (1 + np.exp(-self.logits(text)))
        return [(i, s, float(x)) for i, (s, x) in enumerate(zip(sentences(text), p)) if x >= least]


def _select(texts: list[str | None], y: np.ndarray, features: int) -> list[str]:
    """The features whose presence differs most between the labels, by the chi-square of document counts."""
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    scored, parts = [], [(1, 0)]
    while parts:  # bounded memory: features over MOST are counted in parts by their hash, and none is forgotten
        of, part = parts.pop()
        seen = (Counter(), Counter())
        for text, label in zip(texts, y):
            found = {f for w in set(_WORD.findall((text or "").lower())) for f in features_of(w)}
            seen[int(label)].update(found if of == 1 else (f for f in found if crc32(f.encode("utf-8", "surrogatepass")) % of == part))
            if len(seen[0]) + len(seen[1]) > MOST:
                parts += [(2 * of, part), (2 * of, part + of)]
                break
        else:
            for w in seen[1].keys() | seen[0].keys():
                a, b = seen[1][w], seen[0][w]
                if a + b >= LEAST_DOCS:
                    p = (a + b) / (n1 + n0)
                    scored.append(((a / n1 - b / n0) ** 2 / (p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12), w))
    return [w for x, w in sorted(scored, key=lambda t: (-t[0], t[1]))[:features] if x > 3.8]


def fit(texts: list[str | None], labels: list[int], features: int = FEATURES, rounds: int = 500, l2: float = 1e-3) -> Model:
    """Fit the sentence model to document labels by Adam on the noisy-or log likelihood."""
    y = np.array(labels, float)
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    words = _select(texts, y, features)
    if not words or prior in (0.0, 1.0):
        return Model({}, float(np.log(1e-4)), prior)
    index = {w: i for i, w in enumerate(words)}
    doc, row, col, n = array("i"), array("i"), array("i"), 0
    for d, text in enumerate(texts):
        for s in sentences(text):
            hit = [index[f] for w in set(_WORD.findall(s.lower())) for f in features_of(w) if f in index]
            doc.append(d)
            row.extend([n] * len(hit))
            col.extend(hit)
            n += 1
    doc, row, col = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (doc, row, col))
    w, b, m1, m2 = np.zeros(len(words)), -6.0, 0.0, 0.0
    has = np.bincount(doc, minlength=len(y)) > 0
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[col], minlength=n)
        quiet = np.bincount(doc, -np.logaddexp(0, z), minlength=len(y))  # log P(no sentence is toxic)
        p = np.clip(-np.expm1(quiet), 1e-6, 1 - 1e-9)
        pull = np.where(y == 1, (1 - p) / p, -1.0) * has / len(y)
        g = pull[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(col, g[row], minlength=len(words)) - l2 * w / len(words), g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        step = 0.15 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, b = w + step[:-1], b + step[-1]
    return Model({k: float(v) for k, v in zip(words, w) if abs(v) > 1e-3}, float(b), prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, where=None) -> Model:
    """Fit on at most so many labelled rows, taken in hash order of the id; the labels are the only other input.

    where: a Column over the id that a row must satisfy to be learned from. The sample's text is all that reaches
    the driver. Null labels are left out; a document labelled twice counts once (the larger label), and so does one
    that is there twice (the lesser text).
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).alias("_y")).where("_y is not null and _id is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    if where is not None:
        known = known.where(where(F.col("_id")))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    got = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).collect()  # bounded by rows
    got.sort(key=lambda r: r["_id"])
    return fit([r["_text"] for r in got], [int(r["_y"] > 0) for r in got])


def scores(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Add the toxicity of every whole text, from 0 to 1; texts without a sentence (null, empty, blank) get the prior.

    Repeated rows score alike and come back repeated; a column that is named like the result is replaced.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES weights

    @F.pandas_udf("double")
    def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for s in parts:
            yield pd.Series([m.score(x) for x in s], dtype="float64")

    return docs.withColumn(to, udf(F.col(text)))


def offending_sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The sentences that score at least so much: id, position, sentence, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), F.col(text).alias("_text"))

    def locate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(i, *x) for i, t in zip(part.iloc[:, 0], part["_text"]) for x in shared.value.offending(t, least)]
            yield pd.DataFrame(found, columns=[id_col, "position", "sentence", "score"])

    return rows.mapInPandas(locate, f"`{id_col}` {dict(rows.dtypes)[id_col]}, position int, sentence string, score double")
