"""Near duplicates by SimHash: exact comparison of fingerprints, tile by tile.

Documents with the same fingerprint are one node. Nodes are put into classes by the number of
bits set in each quarter of the fingerprint, and classes are cut into tiles. If the counts of two
classes differ by more than the radius in sum, no pair between them can be within the radius, so
only tiles of classes nearer than that meet, by an equality join on the class. Two tiles are
compared completely with numpy (exclusive or, bit count). A pair of tiles gives a spanning
forest of its links, not all links, so a group of near copies adds no more rows than nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broodspark.llm.common import checkpointed, fresh, slim

QUARTERS = 4
BITS = 64 // QUARTERS
FIELD = 8  # bits of a class number per quarter
MARGIN = 64  # added to each count, so that a neighbour's number never borrows from the next field


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42, chunk: int = 1 << 16) -> int:
    """64 bits; a bit is set if it is set in more than half of the shingles' hashes.

    A-Z are lower-cased; words are runs without ASCII white space; fewer words than a shingle
    make one shingle of all words; no words give zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), chunk):
        part = hashes[at : at + chunk].astype("<u8", copy=False)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(shingle: int = 3, seed: int = 42):
    """A function of the text column: the fingerprint as a signed 64-bit number."""

    def signed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle, seed) for t in batch], np.uint64).view(np.int64))

    return F.pandas_udf(signed, "bigint").asNondeterministic()


def _forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its part) within two tiles; at most one per node."""
    left, right = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
    if same:
        upper = left < right
        left, right = left[upper], right[upper]
    if not len(left):
        return a[:0], a[:0]
    nodes, inverse = np.unique(np.concatenate((a[left], b[right])).view(np.int64), return_inverse=True)
    left, right = inverse[: len(left)], inverse[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def tile_links(nodes: DataFrame, radius: int = 3, tile: int = 2048) -> DataFrame:
    """Links (u, v) that connect all fingerprints of ``nodes`` (column ``fp``, distinct) within the radius."""
    number = F.lit(0).cast("bigint")
    for k in range(QUARTERS):
        quarter = F.shiftrightunsigned("fp", BITS * k).bitwiseAND(F.lit((1 << BITS) - 1))
        number = number + F.shiftleft((F.bit_count(quarter) + MARGIN).cast("bigint"), FIELD * k)
    classed = nodes.select("fp", number.alias("class")).repartition("class").sortWithinPartitions("class", "fp")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_class, held, serial = None, [], 0

        def row():
            return pa.RecordBatch.from_pydict({
                "class": pa.array([held_class], pa.int64()), "tile": pa.array([serial], pa.int64()),
                "data": pa.array([np.concatenate(held).tobytes()], pa.binary()),
            })

        for batch in batches:
            classes = batch.column("class").to_numpy()
            fps = batch.column("fp").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(classes)) + 1).tolist(), len(classes)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                if held and held_class != classes[start]:
                    yield row()
                    held, serial = [], 0
                if held_class != classes[start]:
                    held_class, serial = int(classes[start]), 0
                while start < end:
                    room = tile - sum(map(len, held))
                    held.append(fps[start : min(end, start + room)])
                    start += room
                    if sum(map(len, held)) >= tile:
                        yield row()
                        held, serial = [], serial + 1
        if held:
            yield row()

    tiles = classed.mapInArrow(cut, "class bigint, tile bigint, data binary")
    offsets = [
        sum(d << (FIELD * k) for k, d in enumerate(step))
        for step in product(range(-radius, radius + 1), repeat=QUARTERS)
        if sum(map(abs, step)) <= radius
    ]
    # A step and its opposite reach the same pairs; the class itself is met once per pair of tiles.
    offsets = [o for o in offsets if o >= 0]
    left = tiles.select(
        F.col("class").alias("left_class"), F.col("tile").alias("left_tile"), F.col("data").alias("left"),
        F.explode(F.array(*map(F.lit, offsets))).alias("step"),
    ).withColumn("class", F.col("left_class") + F.col("step"))
    met = left.join(tiles, "class").filter("step > 0 OR left_tile <= tile").select(
        "left", F.col("data").alias("right"), F.expr("step = 0 AND left_tile = tile").alias("same")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            columns = (batch.column(c) for c in ("left", "right", "same"))
            for a, b, same in zip(*columns, strict=True):
                one = np.frombuffer(a.as_py(), np.uint64)
                two = np.frombuffer(b.as_py(), np.uint64)
                u, v = _forest(one, two, radius, same.as_py())
                if len(u):
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.RecordBatch.from_pydict({
                    "u": pa.array(np.concatenate(us), pa.int64()), "v": pa.array(np.concatenate(vs), pa.int64()),
                })

    return met.mapInArrow(compare, "u bigint, v bigint").distinct()


def stars(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node: the root is the smallest node that can be reached.

    Alternating large and small stars: each round hangs the neighbours of a node under its
    smallest neighbour. Ends when a round changes nothing; every round is checkpointed.
    """
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    links = checkpointed(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = links.select(mark).first()[0]
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        ).select("e.*").filter("u <> v").distinct()
        links = checkpointed(small)
        after = links.select(mark).first()[0]
        if after == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, tile: int = 2048
) -> DataFrame:
    """doc_id, fp (signed), component_id for every row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest doc_id that can be reached, the row's own included. A missing text counts as empty; texts
    without words have fingerprint zero and are linked like any other. A missing id
    is never the smallest unless the whole component has none (NULL then). Repeated rows
    stay repeated. An empty table gives an empty result.
    """
    fps = checkpointed(slim(docs, id_col, text_col).select("doc_id", fingerprint_column(shingle)("text").alias("fp")))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    star = stars(tile_links(nodes, radius, tile))
    rooted = nodes.join(star.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = checkpointed(rooted.join(smallest, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of the smallest id of each group, with the columns of the input.

    Rows that repeat an id are one document and stay or go together; documents without an id stay
    only where their whole group has none.
    """
    key = fresh(docs, "_kept_id")
    chosen = (
        near_groups(docs, id_col, text_col, **options).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select(F.col("doc_id").alias(key)).distinct()
    )
    return docs.join(chosen, F.col(id_col).cast("bigint").eqNullSafe(F.col(key)), "left_semi")
