"""Language identification: known words first, then shorter and shorter character n-grams.

A known word counts with its log frequency in each language. An unseen word counts with the
n-grams of the longest length of which at least half are known. Word counts cover every learnable document;
they are added up per task before the shuffle. The model that goes to the tasks holds at
most ``known`` words and ``known`` n-grams of each length and language, the most frequent ones; a
word beyond is an unseen word and backs off.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broodspark.llm.common import checkpointed, fold
from broodspark.llm.linear import letter_words

UNKNOWN = "und"
LENGTHS = (4, 3, 2, 1)


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", hold: int = 400_000) -> DataFrame:
    """(lang, word, n) over all rows that have both; a task holds at most ``hold`` words and then hands them on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, words in counts.items():
                items = list(words.items())
                for at in range(0, len(items), 50_000):
                    part = items[at : at + 50_000]
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(part), pa.string()), "word": pa.array([w.decode() for w, _ in part], pa.string()),
                        "n": pa.array([n for _, n in part], pa.int64()),
                    })
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts.setdefault(lang, Counter()).update(letter_words(text.as_py()))
                if sum(map(len, counts.values())) > hold:
                    yield from rows()
        yield from rows()

    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    return usable.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _grams(text: Column, size: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(1), size - (length - 1)), lambda i: F.substring(text, i, F.lit(length)))


SHARES = 1 << 16  # parts of the words of one count, by their hash


def _most_frequent(counts: DataFrame, group: list[str], name: str, known: int) -> DataFrame:
    """The ``known`` rows of each group with the largest counts, or all of them; of equal counts those with the least hash.

    The least count is read off the histogram of counts, and where its words do not all fit, the least hashes off a
    histogram of hashes. Only the words of one hash part per group are put in order.
    """
    hashed = counts.withColumn("_hash", F.xxhash64(name))
    histogram = hashed.groupBy(*group, "n").agg(F.count("*").alias("words")).toArrow().to_pandas().sort_values("n", ascending=False)
    histogram["above"] = histogram.groupby(group)["words"].cumsum()
    over = histogram[histogram["above"] > known]
    if not len(over):
        return counts
    spark = counts.sparkSession
    border = over.loc[over.groupby(group)["n"].idxmax()].assign(left=lambda h: known - (h["above"] - h["words"]))
    edge = F.broadcast(spark.createDataFrame(border[[*group, "n", "left"]].rename(columns={"n": "_n"})))
    placed = hashed.join(edge, group, "left").withColumn("_part", F.pmod("_hash", F.lit(SHARES)))
    at_edge = placed.filter("n = _n")
    parts = at_edge.groupBy(*group, "_part", "left").agg(F.count("*").alias("words")).toArrow().to_pandas().sort_values("_part")
    parts["above"] = parts.groupby(group)["words"].cumsum()
    last = parts[parts["above"] >= parts["left"]].groupby(group).first().reset_index()
    last["take"] = last["left"] - (last["above"] - last["words"])
    cut = F.broadcast(spark.createDataFrame(last[[*group, "_part", "take"]].rename(columns={"_part": "_last"})))
    placed = placed.join(cut, group, "left")
    whole = placed.filter("_n IS NULL OR n > _n OR (n = _n AND _part < _last)").select(*counts.columns)
    order = Window.partitionBy(*group).orderBy("_hash", name)
    some = placed.filter("n = _n AND _part = _last").withColumn("_place", F.row_number().over(order)).filter("_place <= take")
    return whole.union(some.select(*counts.columns))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", use: Column | None = None, known: int = 40_000) -> dict:
    """The model: languages, words and n-grams with log frequencies per language."""
    if use is not None:
        docs = docs.filter(use)
    words = checkpointed(word_counts(docs, lang_col, text_col))
    # Each distinct word gives its n-grams, ends marked, as often as the root of its count.
    marked = F.concat(F.lit("<"), "word", F.lit(">"))
    size = F.char_length(marked)
    grams = None
    for length in LENGTHS:
        each = _grams(marked, size, length)
        part = words.filter(size >= length).select("lang", F.lit(length).alias("size"), F.explode(each).alias("gram"), F.sqrt("n").alias("w"))
        grams = part if grams is None else grams.union(part)
    grams = checkpointed(grams.groupBy("lang", "size", "gram").agg(F.ceil(F.sum("w")).cast("bigint").alias("n")))
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    gram_totals = {(r["lang"], r["size"]): r["n"] for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}

    def table(frame: pd.DataFrame, column: str, sums: list[float]) -> dict[str, np.ndarray]:
        sums = np.maximum(np.array(sums, float), 1.0)
        place = frame["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy(int) if len(frame) else np.zeros(0, int)
        keys, row = np.unique(frame[column].to_numpy(str), return_inverse=True) if len(frame) else (np.zeros(0, str), np.zeros(0, int))
        values = np.full((len(keys), len(languages)), 0.1)
        np.add.at(values, (row, place), frame["n"].to_numpy(float))
        return {"keys": keys.tolist(), "logs": np.log(values / sums).astype(np.float32)}

    model = {"languages": languages, "words": table(_most_frequent(words, ["lang"], "word", known).toArrow().to_pandas(), "word", list(totals[x] for x in languages))}
    top = _most_frequent(grams, ["lang", "size"], "gram", known).toArrow().to_pandas()
    model["grams"] = {
        n: table(top[top["size"] == n], "gram", [gram_totals.get((x, n), 1) for x in languages]) for n in LENGTHS
    }
    return model


class _Words(dict):
    """Word to its row of the score matrix; unseen words get one when they are first met."""

    def __init__(self, model: dict, remember: int = 200_000) -> None:
        words = model["words"]
        super().__init__((w.encode(), i) for i, w in enumerate(words["keys"]))
        self.fixed = len(self)
        self.remember = remember
        self.logs = np.zeros((self.fixed + remember, len(model["languages"])), np.float32)
        self.logs[: self.fixed] = words["logs"]
        self.grams = [(n, {g: i for i, g in enumerate(t["keys"])}, t["logs"]) for n, t in model["grams"].items()]
        self.met: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        at = self.fixed + len(self.met)
        self.met.append(word)
        self.logs[at] = self._back_off("<" + word.decode() + ">")
        self[word] = at
        return at

    def _back_off(self, marked: str) -> np.ndarray | float:
        for n, rows, logs in self.grams:
            places = [rows.get(marked[i : i + n], -1) for i in range(len(marked) - n + 1)]
            found = [p for p in places if p >= 0]
            if found and 2 * len(found) >= len(places):
                return logs[found].mean(axis=0)
        return 0.0

    def room(self, words: list[bytes]) -> None:
        if len(self.met) + len(words) > self.remember:
            for w in self.met:
                del self[w]
            self.met.clear()

    def total(self, words: list[bytes], part: int = 50_000) -> np.ndarray:
        out = np.zeros(self.logs.shape[1])
        for at in range(0, len(words), part):
            some = words[at : at + part]
            self.room(some)
            out += self.logs[list(map(self.__getitem__, some))].sum(axis=0, dtype=float)
        return out


def predict_column(model: dict):
    """A function of the text column: struct of lang and score."""

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages = model["languages"]
        table = _Words(model) if languages else None
        for batch in texts:
            names, scores = [], []
            for text in batch:
                if table is None or not text or not any(map(str.isalpha, text)):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = table.total(letter_words(text))
                odds = np.exp(total - total.max())
                names.append(languages[int(total.argmax())])
                scores.append(float(odds.max() / odds.sum()))
            yield pd.DataFrame({"lang": names, "score": scores})

    return F.pandas_udf(predict, "lang string, score double").asNondeterministic()


def with_language(docs: DataFrame, folds: int | None = 4, held_out: int = 2, text_col: str = "text", lang_col: str = "lang", into: str = "language", **options) -> DataFrame:
    """Adds a struct (lang, score); every row and column of the input stays.

    Learns from all rows with a text and a language whose id is not in the held-out fold (rows without an id are
    not learned from); with ``folds`` None from all. A missing text, or one without a letter, gives ``und`` and 0, and so
    does every text if nothing could be learned. Ties go to the first language by name.
    """
    use = None if folds is None else fold("doc_id", folds) != held_out
    return docs.withColumn(into, predict_column(fit(docs, lang_col, text_col, use, **options))(text_col))
