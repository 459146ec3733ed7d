"""Packing of tokenised documents into windows, best fit by decreasing length.

Documents are tokenised where they are read. Overlong ones are cut into full windows, and what is left
over goes, with its length only, to evenly dealt partitions, each sorted by decreasing length. A
segment tree over the remaining capacities finds the tightest open window. Only the
open windows are held, as numbers; pieces stream through.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broodspark.llm.common import slim

SPECIAL = "<|endoftext|>"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Encoder:
    """Token ids of whole texts as little-endian 32-bit numbers, as the ``tokenizers`` file gives them.

    A token never reaches over the start of a run of white space, so a text may be cut there; the
    cuts that lie at single spaces repeat between documents and are remembered, up to
    ``remember`` of them. New ones are encoded with the same vocabulary as ranks, which is much faster than the
    other library; texts that hold the special token go through the other library itself.
    """

    def __init__(self, ranks_file: str, json_file: str, remember: int = 300_000) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_file, self.whole = json_file, None
        self.remember, self.known = remember, {}

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            return self._with_special(text)
        known = self.known
        cuts = self._cuts(text)
        try:
            return b"".join([known[c] for c in cuts])
        except KeyError:
            pass
        if len(known) > self.remember:
            known.clear()
        encode = self.ranks.encode_ordinary
        for c in cuts:
            if c not in known:
                known[c] = np.array(encode(c), "<u4").tobytes()
        return b"".join([known[c] for c in cuts])

    @staticmethod
    def _cuts(text: str) -> list[str]:
        first, *rest = text.split(" ")
        cuts = [first] if first else []
        for part in rest:
            if cuts and cuts[-1][-1].isspace():
                cuts[-1] += " " + part
            else:
                cuts.append(" " + part)
        return cuts

    def _with_special(self, text: str) -> bytes:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.json_file)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class Capacities:
    """A segment tree over the remaining capacities 0..size: how many open windows have each."""

    def __init__(self, size: int) -> None:
        self.base = 1 << size.bit_length()
        self.tree = [0] * (2 * self.base)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: tuple[int, int]) -> None:
        self.open[capacity].append(window)
        self._count(capacity, 1)

    def take(self, length: int) -> tuple[int, tuple[int, int]] | None:
        """The window with the least capacity of at least ``length``; none if there is no such window."""
        tree, at = self.tree, length + self.base
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        capacity = at - self.base
        self._count(capacity, -1)
        return capacity, self.open[capacity].pop()

    def _count(self, capacity: int, by: int) -> None:
        at = capacity + self.base
        while at:
            self.tree[at] += by
            at >>= 1


def pieces(docs: DataFrame, ranks_file: str, json_file: str, window: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: the document's ids (its end id included) cut into windows and a rest.

    ``with_ids`` adds the ids themselves as ``ids``.
    """
    kind = pa.schema([pa.field(c.split()[0], pa.int64()) for c in PIECES.split(", ")] + [pa.field("ids", pa.list_(pa.int32()))] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_file, json_file)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encoder(text.as_py()) + end
                total = len(data) // 4
                for start in range(0, total, window):
                    part = data[4 * start : 4 * (start + window)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [*map(list, zip(*rows, strict=True))] if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, ids], kind, strict=False)], schema=kind)

    return docs.mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def place(parts: DataFrame, window: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``window`` ids.

    Each partition packs its own pieces; only open windows that a partition leaves at its end
    are not full. The sequence numbers start at a multiple of 2**36 per partition. Pieces are sorted
    completely, so a task that is run again places them alike.
    """
    order = [F.desc("length"), *(F.asc_nulls_last(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens"))]
    dealt = parts.repartition("doc_id", "start", "ids_crc32").sortWithinPartitions(*order)
    names = parts.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 36
        windows = Capacities(window)
        for batch in batches:
            sequences, offsets = [], []
            for length in batch.column("length").to_pylist():
                found = windows.take(length)
                if found is None:
                    capacity, (sequence, used) = window, (serial, 0)
                    serial += 1
                else:
                    capacity, (sequence, used) = found
                sequences.append(sequence)
                offsets.append(used)
                if capacity > length:
                    windows.add(capacity - length, (sequence, used + length))
            placed = [pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *placed], names=[*names, "sequence_id", "offset"])

    kind = ", ".join(f"{c} {t}" for c, t in parts.dtypes)
    return dealt.mapInArrow(pack, f"{kind}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, ranks_file: str, json_file: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, **options) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A missing text counts as empty: one piece with the end id alone. Repeated rows and rows
    without an id are packed each on its own. Other columns of the input are not read. An empty
    table gives no pieces. Sequences hold at most ``window`` ids and have no gaps; padding to the window is
    left to the reader (none is needed where the length is a power of two).
    """
    return place(pieces(slim(docs, id_col, text_col), ranks_file, json_file, window, **options), window)
