"""Benchmark contamination by a generalised suffix automaton over the words of the test items.

The automaton holds every word sequence of every item. A document's words are streamed through
it; the state after each word is the longest sequence, ending there, that some item contains.
Sequences of at least a window's length mark the window's words as hit, and the state of the
window knows the items that hold it. Items shorter than a window count as one window.

The items are the query set. They reach the tasks in blocks of bounded bytes, one broadcast each. A task
takes some MB of texts at a time as word numbers and streams them through one block after the other: the
automaton of a block is built, used and dropped before the next one. The driver holds one block
at a time; an item longer than a block is cut into parts that overlap by a window less one word, so no
window is lost. Documents are never shuffled, and read once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count, repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broodspark.llm.common import fresh

#: Bytes that belong to words after lower-casing A-Z; all others separate words.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        sequences = []
        for item, text in items:
            words = words_of(text)
            if words:
                numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                sequences.append((item, numbers))
                last = 0
                for n in numbers:
                    last = self._extend(last, n)
        self.shortest = min((min(len(s), window) for _, s in sequences), default=window)
        pairs = [np.array(s[:-1], np.int64) * len(self.vocabulary) + np.array(s[1:], np.int64) for _, s in sequences]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        self.owners: list[set[str] | None] = [None] * len(self.len)
        self.whole: list[dict[int, set[str]] | None] = [None] * len(self.len)
        for item, numbers in sequences:
            self._own(item, numbers)
        # The nearest state, from a state upwards, at which a short item ends.
        self.short_at = [-1] * len(self.len)
        for state in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            self.short_at[state] = state if self.whole[state] else self.short_at[self.link[state]]

    def _extend(self, last: int, n: int) -> int:
        found = self.next[last].get(n)
        if found is not None:
            if self.len[found] == self.len[last] + 1:
                return found
            return self._clone(last, n, found)
        new = self._state(self.len[last] + 1, {})
        at = last
        while at != -1 and n not in self.next[at]:
            self.next[at][n] = new
            at = self.link[at]
        if at == -1:
            self.link[new] = 0
        else:
            found = self.next[at][n]
            self.link[new] = found if self.len[found] == self.len[at] + 1 else self._clone(at, n, found)
        return new

    def _clone(self, at: int, n: int, found: int) -> int:
        copy = self._state(self.len[at] + 1, dict(self.next[found]))
        self.link[copy] = self.link[found]
        self.link[found] = copy
        while at != -1 and self.next[at].get(n) == found:
            self.next[at][n] = copy
            at = self.link[at]
        return copy

    def _state(self, length: int, transitions: dict[int, int]) -> int:
        self.next.append(transitions)
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _walk(self, numbers: list[int]) -> Iterator[tuple[int, int]]:
        """State and matched length after each word; -1 is a word that no item has."""
        state = length = 0
        for n in numbers:
            while state and n not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if n in self.next[state]:
                state = self.next[state][n]
                length += 1
            yield state, length

    def _window_state(self, state: int) -> int:
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _own(self, item: str | None, numbers: list[int]) -> None:
        names = set() if item is None else {item}
        if len(numbers) < self.window:
            *_, (state, length) = self._walk(numbers)
            self.whole[state] = self.whole[state] or {}
            self.whole[state].setdefault(length, set()).update(names)
            return
        for state, length in self._walk(numbers):
            if length >= self.window:
                state = self._window_state(state)
                self.owners[state] = (self.owners[state] or set()) | names

    def match(self, numbers: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of words (start, end), apart from each other and ascending, and the items hit."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()

        def hit(start: int, end: int) -> None:
            while spans and start <= spans[-1][1]:
                before = spans.pop()
                start, end = min(start, before[0]), max(end, before[1])
            spans.append((start, end))

        for at, (state, length) in enumerate(self._walk(numbers), 1):
            if length >= self.window:
                hit(at - self.window, at)
                items |= self.owners[self._window_state(state)] or set()
            short = self.short_at[state]
            while short > 0:
                for size, names in self.whole[short].items():
                    if size <= length:
                        hit(at - size, at)
                        items |= names
                short = self.short_at[self.link[short]]
        return spans, items


class Slice:
    """Some MB of texts as word numbers, a zero before each text, and what the blocks hit in them.

    Words are numbered from one as they come, or by ``vocabulary`` if that has all words of all blocks; others are zero.
    """

    def __init__(self, texts: Iterable[str | None], vocabulary: dict[bytes, int] | None = None) -> None:
        self.vocabulary = defaultdict(count(1).__next__) if vocabulary is None else vocabulary
        parts = []
        for text in texts:
            words = words_of(text)
            numbers = map(self.vocabulary.__getitem__, words) if vocabulary is None else map(vocabulary.get, words, repeat(0))
            parts.append(np.fromiter(numbers, np.int32, len(words)))
        self.sizes = [len(p) for p in parts]
        self.starts = np.cumsum([0, *(n + 1 for n in self.sizes)])[:-1]
        gap = np.zeros(1, np.int32)
        self.numbers = np.concatenate([gap, *(x for p in parts for x in (p, gap))])
        self.spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.items: dict[int, set[str]] = defaultdict(set)

    def stream(self, automaton: Automaton) -> None:
        """Marks what the items of the automaton hit. Stretches without a pair of neighbours of an item are not walked."""
        table = np.full(1 + max(self.vocabulary.values(), default=0), -1, np.int64)
        for word, n in automaton.vocabulary.items():
            if word in self.vocabulary:
                table[self.vocabulary[word]] = n
        numbers = table[self.numbers]
        known = numbers >= 0
        joined = np.zeros(len(numbers), bool)  # with the word after it
        at = np.flatnonzero(known[:-1] & known[1:])
        pairs = automaton.pairs
        if len(at) and len(pairs):
            wanted = numbers[at] * len(automaton.vocabulary) + numbers[at + 1]
            joined[at[pairs[np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)] == wanted]] = True
        first = np.flatnonzero(known & ~np.concatenate(([False], joined[:-1])))
        last = np.flatnonzero(known & ~joined) + 1
        long = last - first >= automaton.shortest
        first, last = first[long], last[long]
        docs = np.searchsorted(self.starts, first, side="right") - 1
        for doc, start, end in zip(docs.tolist(), first.tolist(), last.tolist(), strict=True):
            spans, items = automaton.match(numbers[start:end].tolist())
            if spans:
                offset = start - int(self.starts[doc]) - 1
                self.spans[doc] += [(a + offset, b + offset) for a, b in spans]
                self.items[doc] |= items

    def hits(self, doc: int) -> tuple[list[tuple[int, int]], list[str]]:
        """Spans of a text over all blocks, apart from each other and ascending, and the items."""
        spans: list[tuple[int, int]] = []
        for start, end in sorted(self.spans.get(doc, ())):
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
            else:
                spans.append((start, end))
        return spans, sorted(self.items.get(doc, ()))


def _parts(text: str, window: int, block_bytes: int) -> Iterator[str]:
    """The words of an item in parts of about ``block_bytes``; every window lies in one of them."""
    words = words_of(text)
    first = held = 0
    for end, word in enumerate(words, 1):
        held += len(word) + 1
        if held >= block_bytes and end - first >= window and end < len(words):
            yield b" ".join(words[first:end]).decode()
            first, held = end - window + 1, 0
    yield b" ".join(words[first:]).decode()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list[Broadcast]:
    """The different items in blocks of about ``block_bytes``, one broadcast each; the driver holds one at a time."""
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = items.repartition(1 + total // block_bytes, "item", "text").distinct()
    blocks, block, size = [], [], 0
    for item, text in rows.toLocalIterator():
        for part in _parts(text, window, block_bytes):
            if block and size + len(part) > block_bytes:
                blocks.append(context.broadcast(block))
                block, size = [], 0
            block.append((item, part))
            size += len(part)
    return [*blocks, context.broadcast(block)] if block else blocks


def with_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    coverage: float = 0.05,
    block_bytes: int = 1 << 20,
    slice_bytes: int = 32 << 20,
    into: str = "contamination",
) -> DataFrame:
    """Adds a struct column: n_words, n_hit, items (sorted strings), spans (of words), contaminated, clean_text.

    A word is hit if it lies in an occurrence of a window: ``window`` consecutive words of an item, or
    a whole item of fewer words. A document is contaminated if its hit words are at least ``coverage`` of its
    words, and at least one. ``clean_text`` is the text without its hit words, NULL where nothing is hit.

    A missing or empty text has no words and is clean. Items without words match nothing. Items
    without an id hit words but are not listed; items that repeat an id are listed once. An empty
    benchmark leaves all documents clean. Any other columns of the two tables are kept or ignored.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    return docs.withColumn(into, _marker(blocks, window, coverage, slice_bytes)(text_col))


_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans."""
    data = text.encode()
    places = [m.span() for m in _WORDS.finditer(data)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, data[at:]]).decode()


def _slices(batches: Iterable[pd.Series], slice_bytes: int) -> Iterator[list[pd.Series]]:
    held, size = [], 0
    for texts in batches:
        held.append(texts)
        size += sum(len(t) for t in texts if t)
        if size >= slice_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def mark(
    batches: Iterable[pd.Series], automata: Callable[[], Iterable[Automaton]], coverage: float, slice_bytes: int,
    vocabulary: dict[bytes, int] | None = None,
) -> Iterator[pd.DataFrame]:
    """The result of every text, batch by batch; ``automata`` gives those of all blocks, one after the other."""
    for held in _slices(batches, slice_bytes):
        part = Slice((text for texts in held for text in texts), vocabulary)
        for automaton in automata():
            part.stream(automaton)
            del automaton  # before the next one is built
        doc = 0
        for texts in held:
            rows = []
            for text in texts:
                spans, items = part.hits(doc)
                n_words, n_hit = part.sizes[doc], sum(b - a for a, b in spans)
                rows.append((
                    n_words, n_hit, items, [{"start": a, "end": b} for a, b in spans],
                    n_hit > 0 and n_hit >= coverage * n_words, _without(text, spans) if spans else None,
                ))
                doc += 1
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans", "contaminated", "clean_text"])


def _marker(blocks: list[Broadcast], window: int, coverage: float, slice_bytes: int):
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # A single block serves all slices; of several, only the one in use is in memory, its text too.
        single = [Automaton(b.value, window) for b in blocks] if len(blocks) == 1 else None
        vocabulary = {w: n + 1 for w, n in single[0].vocabulary.items()} if single else None

        def items(block: Broadcast) -> list[tuple[str | None, str]]:
            path = getattr(block, "_path", None)  # none if Spark encrypts its files: the value is there already
            return block.load_from_path(path) if path else block.value

        def automata() -> Iterable[Automaton]:
            return single or (Automaton(items(b), window) for b in blocks)

        yield from mark(batches, automata, coverage, slice_bytes, vocabulary)

    kind = (
        "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>, "
        "contaminated boolean, clean_text string"
    )
    return F.pandas_udf(marked, kind).asNondeterministic()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The clean documents, whole and with the columns of the input."""
    name = fresh(docs, "_contamination")
    return with_contamination(docs, benchmark, into=name, **options).filter(~F.col(name)["contaminated"]).select(*docs.columns)
