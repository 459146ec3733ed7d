"""Byte-level BPE: texts to token ids and back, by batched merge rounds in numpy.

The symbols of many words lie in one flat array. Each round looks at all neighbours that changed, finds their ranks
by binary search in the sorted keys of the merges, takes the lowest rank of every word, and merges
all its places from left to right; words without a mergeable pair leave the array. Texts are cut at white space first;
the pieces of a slice of texts are made distinct, and pieces seen before are remembered, up to a bound.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space of the pattern below, and the pattern that splits texts before the merges.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern never joins what this one parts.
PIECES = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
NONE = np.iinfo(np.int32).max
SLICE = 1 << 21  # bytes of texts whose new words are merged together, or ids that are decoded together
GATHER = 1 << 18  # ids that are looked up together


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, the others follow 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted({*range(256)} - {*shown})
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Vocabulary:
    """Merges, ids and bytes of a byte-level BPE file of the ``tokenizers`` library, as arrays."""

    def __init__(self, json_file: str) -> None:
        with open(json_file, encoding="utf-8") as file:
            stored = json.load(file)
        model, before = stored["model"], stored["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        split = before["type"] == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        added = [t for t in stored["added_tokens"] if any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized"))]
        if model["type"] != "BPE" or not plain or not split or stored["normalizer"] or added:
            raise ValueError(f"{json_file}: not a plain byte-level BPE")
        letters, ids = _letters(), model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.kinds = max(ids.values()) + 1
        keys = np.array([ids[a] * self.kinds + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.arange(len(keys), dtype=np.int32)[order]
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)  # by rank
        self.first = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.first[byte] = ids.get(letter, 0)
        special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.special = special
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

        tokens = {i: raw(t) for t, i in (ids | special).items()}
        listed = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.bytes, self.starts = np.frombuffer(b"".join(listed), np.uint8), np.cumsum([0, *map(len, listed)])
        # Two bytes that no merged token holds side by side are never joined.
        self.joined = np.zeros((256, 256), bool)
        for token in {tokens[ids[a + b]] for a, b in pairs}:
            data = np.frombuffer(token, np.uint8)
            self.joined[data[:-1], data[1:]] = True

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, by binary search over the sorted keys; NONE for pairs that do not merge."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        wanted = left.astype(np.int64) * self.kinds + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE).astype(np.int32)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols, word = self.first[data], np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        ranks = np.full(len(symbols), NONE, np.int32)  # of a symbol and the next one
        inner = np.flatnonzero((word[1:] == word[:-1]) & self.joined[data[:-1], data[1:]])
        ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        # A part is a stretch of a word that merges can reach; parts are numbered in order.
        breaks = np.ones(len(symbols), bool)
        breaks[inner + 1] = False
        part = np.cumsum(breaks) - 1
        place = np.arange(len(symbols))
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            lowest = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(starts, append=len(symbols))
            going = np.repeat(lowest != NONE, lengths)
            if not going.all():
                done.append((place[~going], symbols[~going]))
                symbols, ranks, part, place = symbols[going], ranks[going], part[going], place[going]
                lengths, lowest = lengths[lowest != NONE], lowest[lowest != NONE]
                if not len(symbols):
                    break
            marked = np.flatnonzero(ranks == np.repeat(lowest, lengths))
            # Of neighbouring places of one pair every second merges, from the left.
            fresh = np.concatenate([[True], np.diff(marked) != 1])
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(marked)), 0))
            at = marked[(np.arange(len(marked)) - begin) % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            ranks[at] = ranks[at + 1]  # NONE where the second one ends its part
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            at = at - np.arange(len(at))  # each place moves by the merges before it
            symbols, ranks, part, place = symbols[stays], ranks[stays], part[stays], place[stays]
            after = at[(at + 1 < len(symbols))]
            after = after[part[after + 1] == part[after]]
            before = at[at > 0] - 1
            before = before[part[before] == part[before + 1]]
            for changed in (after, before):
                ranks[changed] = self.rank(symbols[changed], symbols[changed + 1])
        places = np.concatenate([p for p, _ in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(places)
        ids = np.concatenate([s for _, s in done])[order] if done else np.zeros(0, np.int32)
        ends = np.searchsorted(places[order], np.cumsum(sizes)) * 4
        flat = ids.astype("<i4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids in order; ids that the vocabulary does not have stand for nothing."""
        ids = ids[(ids >= 0) & (ids < len(self.starts) - 1)]
        out = []
        for at in range(0, len(ids), GATHER):
            some = ids[at : at + GATHER]
            sizes = self.starts[some + 1] - self.starts[some]
            shift = np.repeat(self.starts[some] - (np.cumsum(sizes) - sizes), sizes)
            out.append(self.bytes[shift + np.arange(len(shift))].tobytes())
        return b"".join(out)


@functools.lru_cache(maxsize=4)
def vocabulary(json_file: str) -> Vocabulary:
    """The file's arrays, read once per process."""
    return Vocabulary(json_file)


class Encoder:
    """Token ids of texts; remembers up to ``remember`` pieces between white space."""

    def __init__(self, vocabulary: Vocabulary, remember: int = 300_000) -> None:
        self.vocabulary, self.remember = vocabulary, remember
        self.known: dict[str, bytes] = {}
        self.words = regex.compile(PATTERN)

    def __call__(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers; a missing text has none."""
        special = self.vocabulary.special_pattern
        split = []
        for text in texts:
            parts = special.split(text) if special and text and special.search(text) else [text or ""]
            split.append([*map(PIECES.findall, parts[::2])] + [parts[1::2]])
        self._learn({p for parts in split for pieces in parts[:-1] for p in pieces})
        look, out = self.known.__getitem__, []
        for *parts, marks in split:
            ids = [b"".join(map(look, pieces)) for pieces in parts]
            for n, mark in enumerate(marks):
                ids[n] += self.vocabulary.special[mark].to_bytes(4, "little")
            out.append(b"".join(ids))
        return out

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > self.remember:
            self.known.clear()
            new = list(pieces)
        index: dict[str, int] = {}
        parts = [[index.setdefault(w, len(index)) for w in self.words.findall(p)] for p in new]
        ids = self.vocabulary.merge([w.encode() for w in index])
        self.known.update((p, b"".join([ids[w] for w in words])) for p, words in zip(new, parts, strict=True))


def _slices(column: pa.Array, sizes: pa.Array) -> Iterator[pa.Array]:
    """The column in parts of about SLICE by the sizes of its values, one value at least."""
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield column.slice(start, end - start)
        start = end


def with_ids(docs: DataFrame, json_file: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text as an array; all rows and columns stay.

    The ids are those of the ``tokenizers`` library without special tokens around the text; the string of an added token in
    a text becomes its id. A missing or empty text has an empty array. Repeated rows get the same ids; a column
    of the name ``into`` is replaced. Nothing is shuffled.
    """

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary(json_file))
        for some in (part for batch in batches for part in _slices(batch, pc.binary_length(batch))):
            ids = encoder(some.to_pylist())
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))

    return docs.withColumn(into, F.arrow_udf(encode, "array<int>").asNondeterministic()(text_col))


def with_decoded(docs: DataFrame, json_file: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text that the ids of each row stand for, special tokens included; all rows and columns stay.

    Bytes that are no UTF-8 become replacement characters, as in the ``tokenizers`` library. A missing array stands for the empty
    text; missing ids and ids beyond the vocabulary for nothing.
    """

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = vocabulary(json_file)
        for some in (part for batch in batches for part in _slices(batch, pc.list_value_length(batch))):
            texts = []
            for row in some:
                ids = np.zeros(0, np.int64) if row.values is None else row.values.fill_null(-1).to_numpy(zero_copy_only=False)
                texts.append(table.decode(ids).decode("utf-8", "replace"))
            yield pa.array(texts, pa.string())

    return docs.withColumn(into, F.arrow_udf(decode, "string").asNondeterministic()(ids_col))
