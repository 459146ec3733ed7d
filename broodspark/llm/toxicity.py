"""Toxicity: a linear classifier that is held to the same score when identity terms are swapped.

Features are the words of a text and their first four and five letters, hashed. The loss is logistic
on the labels, balanced between the classes, plus the squared change of the score between a labelled text and
its counterfactual, in which every identity term is replaced by another one of its kind. So a
mention of a group does not move the score, whatever the labels happen to say.

The model is fitted on a bounded sample of labelled rows (``bound``), of which only
hashed features come to the driver; every document is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log1p

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broodspark.llm.common import fold, fresh
from broodspark.llm.linear import labelled_sample, letter_words, minimise, sigmoid

#: Identity terms by kind; a term is swapped for the next one of its kind and language.
IDENTITY_TERMS = (
    "christian muslim jewish hindu buddhist atheist catholic protestant sikh",
    "christians muslims jews hindus buddhists atheists catholics protestants sikhs",
    "black white asian latino hispanic african european arab",
    "gay lesbian straight bisexual transgender queer heterosexual homosexual",
    "man woman",
    "men women",
    "he she",
    "male female",
    "american mexican chinese indian german french spanish russian",
    "young old",
    "deaf blind disabled",
    "immigrant refugee foreigner native",
    "christ muslim jude hinduist buddhist atheist katholik protestant",
    "mann frau",
    "männer frauen",
    "schwarz weiß asiatisch arabisch",
    "chrétien musulman juif hindou bouddhiste athée",
    "homme femme",
    "hommes femmes",
    "noir blanc asiatique arabe",
    "cristiano musulmán judío hindú budista ateo",
    "hombre mujer",
    "hombres mujeres",
    "negro blanco asiático árabe",
)
SWAPS = {
    a.encode(): b.encode()
    for group in map(str.split, reversed(IDENTITY_TERMS))
    for a, b in zip(group, group[1:] + group[:1], strict=True)
}


def features_of(word: bytes) -> tuple[int, ...]:
    """Hashes of the word and of its first four and five bytes."""
    hashed = xxhash.xxh32_intdigest
    whole = hashed(word)
    if len(word) < 5:
        return (whole,)
    return (whole, hashed(word[:4], 4)) if len(word) < 6 else (whole, hashed(word[:4], 4), hashed(word[:5], 5))


def features(words: Counter) -> dict[int, float]:
    """Hash to log(1 + count) of each feature of the words."""
    counts: Counter = Counter()
    for word, n in words.items():
        for k in features_of(word):
            counts[k] += n
    return {k: log1p(n) for k, n in counts.items()}


def swapped(words: Counter) -> Counter:
    out: Counter = Counter()
    for word, n in words.items():
        out[SWAPS.get(word, word)] += n
    return out


def _rows(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Features of each text and, if it has identity terms, of its counterfactual, as packed numbers."""

    def packed(found: dict[int, float]) -> bytes:
        return np.fromiter(found, np.uint32, len(found)).tobytes() + np.fromiter(found.values(), np.float32, len(found)).tobytes()

    for batch in texts:
        rows = []
        for text in batch:
            words = Counter(letter_words(text))
            named = not SWAPS.keys().isdisjoint(words)
            rows.append((packed(features(words)), packed(features(swapped(words))) if named else None))
        yield pd.DataFrame(rows, columns=["own", "other"])


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every entry."""
    sizes = [len(b) // 8 for b in blobs]
    keys = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(b, np.uint32, n) for b, n in zip(blobs, sizes, strict=True))])
    values = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(b, np.float32, n, 4 * n) for b, n in zip(blobs, sizes, strict=True))])
    return np.repeat(np.arange(len(blobs)), sizes), keys, values


def _document_counts(blobs: pa.Array, y: np.ndarray, part: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each feature, the texts that have it, and those of them with label 1; a part of the texts at a time."""
    known, both, ones = np.zeros(0, np.uint32), np.zeros(0), np.zeros(0)
    for at in range(0, len(y), part):
        row, key, _ = _unpacked(blobs[at : at + part].to_pylist())
        here, column = np.unique(key, return_inverse=True)
        n, n1 = np.bincount(column, minlength=len(here)), np.bincount(column, y[at + row], minlength=len(here))
        merged, column = np.unique(np.concatenate((known, here)), return_inverse=True)
        both = np.bincount(column, np.concatenate((both, n)), len(merged))
        ones = np.bincount(column, np.concatenate((ones, n1)), len(merged))
        known = merged
    return known, both, ones


def _matrix(blobs: pa.Array, chosen: np.ndarray, part: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the entries whose features are chosen."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(blobs), part):
        row, key, value = _unpacked(blobs[at : at + part].to_pylist())
        column = np.minimum(np.searchsorted(chosen, key), len(chosen) - 1)
        inside = chosen[column] == key
        parts.append((at + row[inside], column[inside], value[inside].astype(float)))
    row, column, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    return row, column, value


def fit(
    docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, bound: int = 10_000,
    n_features: int = 4096, evidence: float = 8.0, swap_weight: float = 1.0, shrink: float = 3e-4,
) -> dict:
    """The model: base score and the weights of its features, as {"base": float, "weights": {hash: weight}}.

    Features are kept that at least three sampled texts have and whose counts per label differ with a chi-squared
    of ``evidence`` or more, ``n_features`` at most; identity terms are always kept.
    Labels of ids in fold ``held_out`` are never learned from (none is held out if it is None).
    Without rows of both labels every text gets the share of label 1 that was seen, or 0.
    """
    use = F.lit(True) if held_out is None else fold("doc_id", folds) != held_out
    sample = labelled_sample(docs, labels, "toxic", use, bound)
    rows = F.pandas_udf(_rows, "own binary, other binary").asNondeterministic()
    found = sample.select("doc_id", "label", rows("text").alias("x")).dropDuplicates(["doc_id"]).select("doc_id", "label", "x.*")
    table = found.toArrow().sort_by("doc_id")
    own, other = (table.column(c).combine_chunks() for c in ("own", "other"))
    y = table.column("label").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return {"base": float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), "weights": {}}
    known, both, ones = _document_counts(own, y)
    expected = both * y.mean()
    chi = (ones - expected) ** 2 / (expected * (1 - both / len(y)) + 1)
    chi[both < 3] = 0
    swaps = np.array([xxhash.xxh32_intdigest(t) for t in SWAPS], np.uint32)
    chi[np.isin(known, swaps)] = np.inf  # identity terms stay in, or there is nothing to penalise
    best = np.argsort(-chi, kind="stable")[:n_features]
    chosen = np.sort(known[best[chi[best] >= evidence]])
    if not len(chosen):
        chosen = np.sort(known[best])

    row, column, value = _matrix(own, chosen)
    first = np.flatnonzero(other.is_valid().to_numpy(zero_copy_only=False))
    pair = np.full(len(y), -1)
    pair[first] = np.arange(len(first))
    r2, c2, v2 = _matrix(other.drop_null(), chosen)
    mine = np.isin(row, first)
    # The change of a pair: own features minus those of the counterfactual.
    pr = np.concatenate((pair[row[mine]], r2))
    pc = np.concatenate((column[mine], c2))
    pv = np.concatenate((value[mine], -v2))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    n = len(chosen)

    def gradient(w: np.ndarray) -> np.ndarray:
        score = np.bincount(row, value * w[column], len(y)) + w[n]
        wrong = weight * (sigmoid(score) - y)
        g = np.append(np.bincount(column, value * wrong[row], n), wrong.sum())
        if len(first):
            change = np.bincount(pr, pv * w[pc], len(first))
            g[:n] += 2 * swap_weight / len(first) * np.bincount(pc, pv * change[pr], n)
        g[:n] += shrink * w[:n]
        return g

    w = minimise(gradient, n + 1, steps=250)
    return {"base": float(w[n]), "weights": dict(zip(chosen.tolist(), w[:n].tolist(), strict=True))}


class _Known(dict):
    """Word to those of its features that the model has; a bounded number of words is remembered."""

    def __init__(self, weights: dict[int, float], remember: int = 300_000) -> None:
        super().__init__()
        self.weights, self.remember = weights, remember

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(k for k in features_of(word) if k in self.weights)
        if len(self) < self.remember:
            self[word] = found
        return found


def score_column(model: dict):
    """A function of the text column: the probability of the label 1. A missing text counts as empty."""

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = model["weights"]
        known = _Known(weights)
        for batch in texts:
            sums = []
            for text in batch:
                counts: Counter = Counter()
                for word in letter_words(text or ""):
                    for k in known[word]:
                        counts[k] += 1
                sums.append(model["base"] + sum(log1p(counts[k]) * weights[k] for k in sorted(counts)))
            yield pd.Series(sigmoid(np.array(sums, float)))

    return F.pandas_udf(score, "double").asNondeterministic()


def with_score(docs: DataFrame, labels: DataFrame, text_col: str = "text", into: str = "score", **options) -> DataFrame:
    """Adds the score (0 to 1) to every row; all columns and rows of the input stay.

    Empty and missing texts get the score of a text without features. Repeated rows get the same score.
    """
    return docs.withColumn(into, score_column(fit(docs, labels, **options))(F.coalesce(text_col, F.lit(""))))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows with a score under the threshold, with the columns of the input."""
    name = fresh(docs, "_toxic")
    return with_score(docs, labels, into=name, **options).filter(F.col(name) < threshold).select(*docs.columns)
