"""Periodic runs: stretches of words that repeat with a period, found by recursive frequency splitting.

A word of a run occurs at least twice in it. So a word that occurs once in its segment joins no run and splits the segment;
in the smaller segments more words occur once, and so on until nothing changes. Natural text is gone
after a few rounds. What survives is scanned lag by lag: a run of period q has a stretch of at
least max(12 - q, q) words that equal the word q further on, so looking at every max(12 - q, q)-th word misses none. All
documents of a slice of a batch are split together, as one flat array of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 12
SLICE = 1 << 21  # characters that are numbered together
SAMPLES = 1 << 20  # comparisons that are held together
#: A run: first word, number of words, period.
Run = tuple[int, int, int]


def words_of(text: str | None) -> list[bytes]:
    """The words between blanks and the controls 9 to 13, which is what bytes are split at."""
    return text.encode().split() if text else []


def surviving(words: np.ndarray, documents: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """The segments (first, end) without a word that occurs once in its segment; never across documents."""
    if not len(words):
        return []
    places, segments, kinds = np.arange(len(words)), documents.astype(np.int64), int(words.max()) + 1
    while True:
        _, which, counts = np.unique(segments * kinds + words[places], return_inverse=True, return_counts=True)
        often = counts[which] > 1
        places, segments = places[often], segments[often]
        if not len(places):
            return []
        cut = np.flatnonzero((np.diff(places) != 1) | (np.diff(segments) != 0)) + 1
        first, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(places)]])
        long = end - first >= least
        if often.all() and long.all():
            return list(zip(places[first].tolist(), (places[end - 1] + 1).tolist(), strict=True))
        kept = np.repeat(long, end - first)
        places, segments = places[kept], np.repeat(np.arange(len(first)), end - first)[kept]


def _likely(words: np.ndarray, lags: np.ndarray, least: int, reach: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place) by lag: places that lie in a stretch of equal words long enough, as far as ``reach`` words tell."""
    size = len(words)
    steps = np.maximum(least - lags, lags)
    numbers = -(-(size - lags) // steps)
    lag = np.repeat(lags, numbers)
    place = (np.arange(len(lag)) - np.repeat(np.cumsum(numbers) - numbers, numbers)) * np.repeat(steps, numbers)
    same = words[place] == words[place + lag]
    lag, place = lag[same], place[same]
    stretch = np.ones(len(lag), np.int64)
    for way in (1, -1):
        alive, at = np.arange(len(lag)), place.copy()
        for _ in range(reach):
            at = at + way
            inside = (at >= 0) & (at + lag[alive] < size)
            alive, at = alive[inside], at[inside]
            equal = words[at] == words[at + lag[alive]]
            alive, at = alive[equal], at[equal]
            if not len(alive):
                break
            stretch[alive] += 1
    enough = stretch >= np.minimum(np.maximum(least - lag, lag), reach)
    return lag[enough], place[enough]


def scanned(words: np.ndarray, least: int = LEAST) -> list[Run]:
    """All runs of a segment, by lag. A run whose words also repeat with a part of the lag has that smaller period."""
    size, runs = len(words), []
    longest = size // 2
    lag = 1
    while lag <= longest:
        # Lags up to twice this one take at most size samples each; larger ones take fewer.
        some = max(1, SAMPLES // (size // max(least - lag, lag) + 1))
        lags = np.arange(lag, min(lag + some, longest + 1))
        lag = int(lags[-1]) + 1
        found, places = _likely(words, lags, least)
        if not len(found):
            continue
        values, firsts = np.unique(found, return_index=True)
        ends = [*firsts[1:].tolist(), len(found)]
        for q, first, end in zip(values.tolist(), firsts.tolist(), ends, strict=True):
            at = places[first:end]
            for start, length, period in runs:
                # Inside a long run of a period that divides the lag there is nothing new.
                if q % period == 0 and length >= q + period:
                    at = at[(at < start) | (at + q >= start + length)]
            if not len(at):
                continue
            breaks = np.flatnonzero(words[:-q] != words[q:])
            after = np.searchsorted(breaks, at)
            starts = np.unique(np.where(after > 0, breaks[after - 1] + 1 if len(breaks) else 0, 0))
            after = np.searchsorted(breaks, starts)
            stops = np.where(after < len(breaks), breaks[np.minimum(after, len(breaks) - 1)] if len(breaks) else 0, size - q)
            for start, length in zip(starts.tolist(), (stops - starts + q).tolist(), strict=True):
                if length < max(least, 2 * q):
                    continue
                if any(q % p == 0 and s <= start and start + length <= s + n for s, n, p in runs):
                    continue
                runs.append((start, length, q))
    return runs


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[Run]]:
    """The runs of each text, by start and then by period."""
    index: dict[bytes, int] = {}
    number = index.setdefault
    words = np.fromiter((number(w, len(index)) for text in texts for w in text), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(sizes) - sizes
    found: list[list[Run]] = [[] for _ in texts]
    document = np.repeat(np.arange(len(texts)), sizes)
    for first, end in surviving(words, document, least):
        doc = int(document[first])
        shift = first - int(offsets[doc])
        found[doc] += [(start + shift, length, period) for start, length, period in scanned(words[first:end], least)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def collapsed(words: list[bytes], runs: list[Run]) -> str:
    """The words joined by one space, without those that a run repeats after its first period."""
    kept, at = [], 0
    for start, length, period in sorted(runs, key=lambda r: r[0] + r[2]):
        if start + period > at:
            kept += words[at : start + period]
        at = max(at, start + length)
    return b" ".join([*kept, *words[at:]]).decode()


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text or "")
        if size > SLICE:
            yield some
            some, size = [], 0
    if some:
        yield some


def with_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, into: str = "periodic") -> DataFrame:
    """Adds a struct: n_words, runs (start, length, period; by start, then period), collapsed; all rows and columns stay.

    A run is a stretch of words with smallest period q and at least max(``least``, 2 q) words that no word beside
    it continues. ``collapsed`` is the text without the repetitions, its words joined by one space. A missing or empty text has no words and
    no runs, and collapses to the empty text. Runs may overlap; a word goes if any of them repeats it. Repeated rows
    get the same result; a column of the name ``into`` is replaced. Nothing is shuffled: a task holds a slice of a batch.
    """

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for some in _slices(batch.tolist()):
                texts = [words_of(t) for t in some]
                for words, runs in zip(texts, runs_of(texts, least), strict=True):
                    rows.append((len(words), [{"start": s, "length": n, "period": p} for s, n, p in runs], collapsed(words, runs)))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    kind = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.withColumn(into, F.pandas_udf(scan, kind).asNondeterministic()(text_col))


def longest(runs: Column) -> Column:
    """The run with most words, of those the first, of those the one with the smallest period; NULL without runs."""
    def less(a: Column, b: Column) -> Column:
        order = F.struct(-a["length"], a["start"], a["period"]) < F.struct(-b["length"], b["start"], b["period"])
        return F.when(order, -1).otherwise(1)

    return F.get(F.array_sort(runs, less), F.lit(0))


def with_repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Test damage: every tenth document, by the CRC-32 of its id, repeats a part of itself to its end.

    With h the checksum and g its tenth part, the words from a = g mod n on follow the period 1 + (n - a) div (3 + g mod 8).
    Damaged texts have their words joined by one space; others, and documents without an id, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
        part = F.slice(words, a + 1, p)
        tail = F.slice(F.flatten(F.array_repeat(part, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(F.lit(""))

    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    damaged = F.get(F.transform(F.array(words), again), F.lit(0))
    return docs.withColumn(text_col, F.when((h % 10 == 0) & F.col(text_col).isNotNull(), damaged).otherwise(F.col(text_col)))
