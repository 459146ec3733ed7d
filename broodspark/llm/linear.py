"""What the learned operators share: bounded labelled samples, words, and a small optimiser."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broodspark.llm.common import slim

#: ASCII letters in lower case and all bytes from 128 on are letters of words; the rest separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letter_words(text: str) -> list[bytes]:
    return text.lower().encode().translate(LETTERS).split()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, bound: int) -> DataFrame:
    """(doc_id, text, label) of about ``bound`` labelled rows at most, chosen by a hash of the id.

    ``use`` says which rows of ``labels`` may be learned from. Ids or labels that are missing are
    not used; a label that is given twice counts once, the larger one. The sample is bounded, so it may be
    broadcast to the documents, which are not shuffled.
    """
    usable = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).filter(use)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    total = usable.count()
    if total > bound:
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int((1 << 32) * bound / total))
    return slim(docs).join(F.broadcast(usable), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def minimise(gradient: Callable[[np.ndarray], np.ndarray], size: int, steps: int = 400, rate: float = 0.1) -> np.ndarray:
    """Adam with a falling rate, from zero; the same result on every run."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w
