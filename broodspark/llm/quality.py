"""Quality by Bradley-Terry ranking: scores of documents are learned from pairs, one preferred to the other.

Every labelled good document is preferred to every labelled bad one; a bounded number of such pairs
is drawn for each document. The loss is logistic on the difference of the features of a
pair, so the model learns an order. The cut is a quantile of the scores of all documents; its level is
the share of bad labels. A logistic curve through that cut gives scores from 0 to 1.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broodspark.llm.common import checkpointed, fold, slim
from broodspark.llm.linear import labelled_sample, minimise, sigmoid

NAMES = (
    "log_words distinct_words distinct_words_root top_word neighbours_same mean_length long_words upper_letters "
    "upper_words digits marks pipes stars percent_dollar exclamations other_marks marked_words end_marks "
    "lines_per_word same_lines compressed letters spaces"
).split()
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_LETTERS = bytes(b for b in range(256) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def measures(text: str) -> list[float]:
    """What can be counted on a whole text without knowing its language; zeros for no text."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(data)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    marks = size - len(data.translate(None, _MARKS))
    letters = size - len(data.translate(None, _LETTERS))
    upper = size - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    def share(characters: bytes) -> float:
        return sum(map(data.count, (bytes([c]) for c in characters))) / n

    same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    packed = sum(len(zlib.compress(data[i : i + 30_000], 1)) for i in range(0, size, 30_000)) / size
    return [
        np.log1p(n), len(counts) / n, len(counts) / n**0.5 / 10, max(counts.values()) / n, same / max(1, n - 1),
        letters / n / 10, sum(1 for w in counts if len(w) > 25) / len(counts), upper / max(1, letters),
        sum(map(bytes.isupper, words)) / n, (size - len(data.translate(None, b"0123456789"))) / size,
        marks / n, share(b"|"), share(b"*#&"), share(b"%$"), share(b"!"), share(b"<>{}[]=;_~^"),
        sum(1 for w in words if not w.strip(_MARKS)) / n, share(b".?"),
        len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), packed, letters / size, data.count(b" ") / n,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every row."""

    def rows(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([measures(t) for t in batch])

    column = F.pandas_udf(rows, "array<double>").asNondeterministic()
    return slim(docs).select("doc_id", column("text").alias("x"))


def fit(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int | None = 2, bound: int = 12_000,
    pairs_each: int = 8, shrink: float = 1e-3, seed: int = 5,
) -> dict:
    """The model: centre, spread, hinges and weights, the share of bad labels, and the point that parts the labels.

    Fitted on about ``bound`` labelled rows at most; ids of the fold ``held_out`` are left out. Without rows of
    both labels there are no pairs: all weights are zero.
    """
    use = F.lit(True) if held_out is None else fold("doc_id", folds) != held_out
    sample = labelled_sample(docs, labels, "quality", use, bound)
    label = sample.select("doc_id", "label").dropDuplicates(["doc_id"])
    table = (
        measured(sample).dropDuplicates(["doc_id"]).join(F.broadcast(label), "doc_id").toArrow().to_pandas().sort_values("doc_id")
    )
    y = table["label"].to_numpy(int)
    x = np.stack(table["x"].tolist()) if len(table) else np.zeros((0, len(NAMES)))
    model = {"knots": None, "centre": None, "spread": None, "weights": None, "bad": float((y == 0).mean()) if len(y) else 0.0, "point": None}
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    model["knots"] = np.quantile(x, [0.02, 0.05, 0.1, 0.2, 0.5, 0.8, 0.9, 0.95, 0.98], axis=0)
    wide = hinges(x, model["knots"])
    model["centre"], model["spread"] = wide.mean(axis=0), wide.std(axis=0) + 1e-6
    wide = (wide - model["centre"]) / model["spread"]
    draw = np.random.default_rng(seed)
    n = max(len(good), len(bad)) * pairs_each
    better = np.resize(good, n)
    worse = draw.permutation(np.resize(bad, n))

    def gradient(w: np.ndarray) -> np.ndarray:
        score = wide @ w
        wrong = -sigmoid(score[worse] - score[better]) / n
        push = np.bincount(better, wrong, len(y)) - np.bincount(worse, wrong, len(y))
        return push @ wide + shrink * w

    model["weights"] = minimise(gradient, wide.shape[1], steps=250, rate=0.05)
    model["point"] = parting(wide @ model["weights"], y)
    return model


def parting(score: np.ndarray, y: np.ndarray) -> float:
    """The point with the fewest good labels below and bad ones above; of several, the middle one."""
    order = np.argsort(score, kind="stable")
    sorted_score, good = score[order], y[order] == 1
    wrong = np.concatenate(([0], np.cumsum(good))) + np.concatenate((np.cumsum(~good[::-1])[::-1], [0]))
    between = np.concatenate((sorted_score[:1] - 1, (sorted_score[1:] + sorted_score[:-1]) / 2, sorted_score[-1:] + 1))
    best = between[wrong == wrong.min()]
    return float(best[len(best) // 2])


def hinges(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """The measures and, per knot, what exceeds it."""
    return np.concatenate([x, *(np.maximum(0, x - k) for k in knots)], axis=1)


def raw_score(model: dict):
    """A function of the measures: the Bradley-Terry score, unbounded."""

    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in columns:
            if model["weights"] is None or not len(batch):
                yield pd.Series(np.zeros(len(batch)))
                continue
            wide = (hinges(np.stack(batch.tolist()), model["knots"]) - model["centre"]) / model["spread"]
            # Row by row, so that equal texts score alike in any batch.
            yield pd.Series(np.round((wide * model["weights"]).sum(axis=1), 9))

    return F.pandas_udf(score, "double").asNondeterministic()


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, level: float | None = None, **options) -> DataFrame:
    """(doc_id, raw, score, good) for every row, repeated rows too.

    The cut is the quantile of all documents' raw scores at ``level``, by default the share of bad labels; a
    score of ``threshold`` or more means at or above the cut. Empty and missing texts are measured as zeros and
    scored like others. Without labels of both kinds every score is 0.5. An empty table gives no rows.
    """
    model = fit(docs, labels, **options)
    raw = checkpointed(measured(docs).select("doc_id", raw_score(model)("x").alias("raw")))
    if model["weights"] is None:
        return raw.select("doc_id", "raw", F.lit(0.5).alias("score"), F.lit(0.5 >= threshold).alias("good"))
    share = model["bad"] if level is None else level
    cut = raw.agg(F.percentile_approx("raw", F.lit(float(share)), F.lit(100_000))).first()[0]
    cut = model["point"] if cut is None else cut
    logit = float(np.log(threshold / (1 - threshold)))
    score = 1 / (1 + F.exp(-((F.col("raw") - F.lit(float(cut))) + logit)))
    score = F.when(F.col("raw") >= F.lit(float(cut)), F.greatest(score, F.lit(threshold))).otherwise(
        F.least(score, F.lit(np.nextafter(threshold, 0).item()))
    )
    return raw.select("doc_id", "raw", score.alias("score"), (F.col("raw") >= F.lit(float(cut))).alias("good"))
