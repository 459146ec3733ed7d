"""Removal of long byte strings that an earlier document has, by a column-wise suffix order.

The method inserts one symbol per string and round, from the right, into the Burrows-Wheeler transform
of a collection and keeps the common prefixes of neighbours up to date, with sequential passes only.
Over whole documents that needs as many rounds as the longest one has bytes, each over
all bytes so far. So the collection is first divided without losing a match:

- Every string of ``length`` bytes has an anchor: the leftmost of its k-grams with the least hash. Neighbouring
  strings with the same anchor form a segment. Equal strings have equal anchors, so they
  meet if segments are dealt out by the hash of the anchor. A segment is at most 2 * length - k long.
- An anchor with more than ``most`` different segments is divided further: each of its strings is a segment of
  its own, dealt out by a hash of the anchor and of the whole string. Equal strings still meet, and different
  ones share no key, however common what they have in common is.
- Documents are dealt into groups of bounded size. A group sends each distinct segment once, as a digest with
  its least document id, so a passage with very many copies sends one entry per group.
- A range of anchor hashes sees all digests. Where one digest is all there is, its least id is the answer. Where
  different segments share an anchor, one copy of each is asked for. Those that share with another one a stretch
  nearly as long as a string go to the column-wise construction, which orders all their suffixes;
  the others cannot share a string. Runs with common prefixes of ``length`` or more are equal strings.
- The answers go back to the groups as one bit per string, and each group finishes its documents.

Digests are 64 bits within equal anchor hashes. The arrays of a collection stay in memory, as a
collection is bounded (``batch`` segments, or ``most`` of one anchor); every pass over them is sequential.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broodspark.llm.common import slim

BLOCK_BITS = 17
BLOCK = 1 << BLOCK_BITS  # positions that the low bits of a hash have room for
STEP = 1 << 14  # positions that are hashed at once; their arrays fit the cache of a core
SLOT_BITS = 24  # frequent anchors are known by this many bits of their hash
SLACK = 8  # bytes by which stretches that segments must share are shorter than a string
COUNTED = 4 << 20  # bytes of text in which the segments of an anchor are counted together
NEVER = np.iinfo(np.int64).max  # the id of documents without one: never smaller than another
_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9))


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number per byte value, and powers of the base and of its inverse modulo 2**64."""
    table = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
    up = np.full(STEP + 1, _BASE, np.uint64)
    down = np.full(STEP + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return table, np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _MIX[0]
    x ^= x >> np.uint64(29)
    x *= _MIX[1]
    x ^= x >> np.uint64(32)
    return x


def _block_segments(data: np.ndarray, piece: np.ndarray, length: int, k: int, powers: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Segments of a block: first string, number of strings, anchor hash, digest.

    ``piece`` numbers the documents of the bytes; strings over two documents do not count.
    """
    table, up, down = powers
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * up[:n], out=sums[1:])
    grams = n - k + 1
    hashes = _mixed((sums[k:] - sums[:grams]) * down[:grams])
    low = np.uint64(BLOCK - 1)
    least = hashes & ~low
    least |= np.arange(grams, dtype=np.uint64)
    width, covered = length - k + 1, 1
    while 2 * covered <= width:
        least = np.minimum(least[:-covered], least[covered:], out=least[:-covered])
        covered *= 2
    if covered < width:
        least = np.minimum(least[: covered - width], least[width - covered :], out=least[: covered - width])
    anchor = (least & low).astype(np.int64)
    strings = len(anchor)
    inside = piece[:strings] == piece[length - 1 :]
    starts = np.ones(strings, bool)
    np.not_equal(anchor[1:], anchor[:-1], out=starts[1:])
    starts[1:] |= piece[1:strings] != piece[: strings - 1]
    stops = np.append(np.flatnonzero(starts | ~inside), strings)
    turn = np.flatnonzero((starts & inside)[stops[:-1]])
    first, end = stops[turn], stops[turn + 1]
    digest = _mixed((sums[end - 1 + length] - sums[first]) * down[first] + (end - first).astype(np.uint64))
    # Anchors are least hashes and so crowd near zero; mixed once more, they deal out evenly.
    return first, end - first, _mixed(hashes[anchor[first]]), digest


def _segments(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> list[np.ndarray]:
    """Segments of documents that end at ``ends``: first string, number of strings, anchor hash, digest, document."""
    parts, powers = [], _powers()
    for at in range(0, max(0, len(data) - length + 1), STEP - length + 1):
        block = data[at : at + STEP]
        low, high = np.searchsorted(ends, (at, at + len(block) - 1), side="right")
        stops = np.minimum(ends[low : high + 1], at + len(block)) - at
        piece = np.repeat(np.arange(low, high + 1), np.diff(stops, prepend=0))
        first, count, hashes, digest = _block_segments(block, piece, length, k, powers)
        parts.append((first + at, count, hashes, digest, piece[first]))
    empty = [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64)]
    return [np.concatenate(x) for x in zip(empty, *parts, strict=True)]


def _divided(data: np.ndarray, segments: list[np.ndarray], length: int, frequent: np.ndarray) -> list[np.ndarray]:
    """The segments, with one for each string where the anchor's slot is frequent; those have a hash of anchor and string."""
    slot = segments[2] >> np.uint64(64 - SLOT_BITS)
    hot = (frequent[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
    if not hot.any():
        return segments
    first, count, hashes, _, piece = (x[hot] for x in segments)
    before = np.repeat(np.cumsum(count) - count, count)
    starts = np.repeat(first, count) + np.arange(len(before)) - before
    table, up, _ = _powers()
    total = np.zeros(len(starts), np.uint64)
    for i in range(length):
        total += table[data[starts + i]] * up[i]
    digest = _mixed(total + np.uint64(1))  # as the digest of a segment of one string
    single = (starts, np.ones(len(starts), np.int64), _mixed(np.repeat(hashes, count) ^ digest), digest, np.repeat(piece, count))
    return [np.concatenate((x[~hot], y)) for x, y in zip(segments, single, strict=True)]


def _counts(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """(anchor, n): anchors with several different segments in some MB of text, and how many."""
    kind = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])

    def counted(texts: list[bytes]) -> pa.RecordBatch:
        _, _, hashes, digest, _ = _segments(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), length, k)
        order = np.argsort(digest)
        hashes, n = np.unique(hashes[order[np.flatnonzero(np.diff(digest[order], prepend=~digest[order][:1]))]], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(hashes[n > 1].view(np.int64)), pa.array(n[n > 1])], schema=kind)

    texts, held = [], 0
    for batch in batches:
        for text in batch.column("text"):
            texts.append(text.as_py().encode())
            held += len(texts[-1])
            if held >= COUNTED:
                yield counted(texts)
                texts, held = [], 0
    yield counted(texts)


def frequent_anchors(source: DataFrame, length: int, k: int, most: int) -> np.ndarray:
    """Bits of the slots of hashes in which an anchor has more than ``most`` different segments; empty if none has.

    The bits are 2 MB however many anchors are frequent; another anchor of such a slot is divided too. Segments are
    added up over parts of the text: one counts once per part, and one that is alone with its anchor there does not. So a few
    more or fewer anchors may be divided; all this moves work only, as all groups divide the same ones.
    """
    parts = source.select("text").mapInArrow(lambda batches: _counts(batches, length, k), "anchor bigint, n bigint")
    page = 1 << 15  # bits of a bitmap of Spark
    slots = parts.groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select(
        F.shiftrightunsigned("anchor", 64 - SLOT_BITS).alias("slot")
    )
    pages = slots.groupBy(F.floor(F.col("slot") / page).alias("page")).agg(F.bitmap_construct_agg(F.col("slot") % page).alias("bits")).collect()
    if not pages:
        return np.zeros(0, np.uint8)
    bits = np.zeros((1 << SLOT_BITS) // 8, np.uint8)
    for row in pages:
        bits[row.page * page // 8 :][: page // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


class Group:
    """The documents of a group, their segments, and the distinct ones in the order of (hash, digest)."""

    def __init__(self, table: pa.Table, length: int, k: int, frequent: np.ndarray | None = None) -> None:
        # Blocks run over the documents in this order, and a shuffle may deliver them in any.
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = table.column("doc_id").combine_chunks()
        self.ids = ids.to_pylist()
        self.order = ids.fill_null(NEVER).to_numpy()
        self.texts = [t.as_py().encode() for t in table.column("text")]
        self.length = length
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        ends = np.cumsum([len(t) for t in self.texts])
        self.starts = np.concatenate(([0], ends))
        segments = _segments(self.data, ends, length, k)
        if frequent is not None and len(frequent):
            segments = _divided(self.data, segments, length, frequent)
        self.first, self.count, hashes, digest, self.piece = segments
        doc = self.order[self.piece] if len(self.piece) else np.zeros(0, np.int64)
        by_digest = np.argsort(digest, kind="stable")
        turn = np.flatnonzero(np.diff(digest[by_digest], prepend=~digest[by_digest][:1]))
        least = np.minimum.reduceat(doc[by_digest], turn) if len(turn) else doc
        sample = by_digest[turn]
        by_hash = np.argsort(hashes[sample], kind="stable")
        self.hashes, self.digest, self.least, self.sample = (x[by_hash] for x in (hashes[sample], digest[sample], least, sample))
        place = np.empty(len(turn), np.int64)
        place[by_hash] = np.arange(len(turn))
        self.entry = np.empty(len(digest), np.int64)
        self.entry[by_digest] = np.repeat(place, np.diff(np.append(turn, len(digest))))

    def removed(self, entries: np.ndarray, masks: np.ndarray) -> list[tuple]:
        """The result of each document, given the strings of entries that an earlier group or document has."""
        mask = np.zeros(len(self.digest), np.uint64)
        mask[entries] = masks
        mask = mask[self.entry]
        doc = self.order[self.piece] if len(self.piece) else np.zeros(0, np.int64)
        mask[doc > self.least[self.entry]] = ~np.uint64(0)
        change = np.zeros(len(self.data) + 1, np.int32)
        hit = np.flatnonzero(mask)
        for string in range(int(self.count.max(initial=0))):
            hit = hit[self.count[hit] > string]
            found = self.first[hit[(mask[hit] >> np.uint64(string)) & np.uint64(1) == 1]] + string
            change[found] += 1  # a string starts once at a place
            change[found + self.length] -= 1
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        rows = []
        for i, text in enumerate(self.texts):
            cut = gone[self.starts[i] : self.starts[i + 1]]
            n = int(cut.sum())
            spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if n else 0
            kept = self.data[self.starts[i] : self.starts[i + 1]][~cut].tobytes() if n else text
            rows.append((self.ids[i], len(text), n, spans, kept))
        return rows


def column_wise(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of a collection in order: string, length of the suffix, common prefix with the one before.

    Round j inserts the suffix of length j + 1 of every string that is long enough. The transform is kept as
    its positions per symbol, ascending: writing the symbol before the suffix of round j - 1 into it gives, by
    its rank, the place of the longer suffix. The common prefix with a neighbour is one more than the least
    one between the two equal symbols in the transform. Each round passes over the arrays in sequence.
    """
    m = len(starts)
    bits, place_bits = 48, (1 << 48) - 1
    codes = np.arange(256, dtype=np.int64) << bits
    last = starts + sizes - 1
    transform = np.zeros(0, np.int64)  # symbol and position of every entry that has a symbol
    common, owner, size = np.zeros(m + 1, np.uint8), np.arange(m, dtype=np.int32), np.zeros(m, np.uint8)
    place = np.arange(m)
    active = np.arange(m)
    for j in range(int(sizes.max(initial=0))):
        active = active[sizes[active] > j]
        active = active[np.argsort(place[active])]
        at = place[active]
        written = codes[data[last[active] - j]] | at
        turn = np.argsort(written)
        rank = np.searchsorted(transform, written[turn]) + np.arange(len(at))
        n, total = len(transform) + len(at), len(owner) + len(at)
        kept = np.ones(n, bool)
        kept[rank] = False
        merged = np.empty(n, np.int64)
        merged[kept], merged[rank] = transform, written[turn]
        mine = np.empty(len(at), np.int64)
        mine[turn] = rank
        new = m + mine
        before = merged[np.maximum(mine - 1, 0)]
        after = merged[np.minimum(mine + 1, n - 1)]
        follows = (mine > 0) & (before >> bits == written >> bits)
        leads = (mine + 1 < n) & (after >> bits == written >> bits)
        own = np.zeros(len(at), np.uint8)
        bounds = np.column_stack(((before & place_bits) + 1, at + 1))[follows].ravel()
        if len(bounds):
            own[follows] = np.minimum.reduceat(common, bounds)[::2] + 1
        bounds = np.column_stack((at + 1, (after & place_bits) + 1))[leads].ravel()
        old = np.ones(total, bool)
        old[new] = False
        longer = np.zeros(total + 1, np.uint8)
        longer[:-1][old] = common[:-1]
        longer[new] = own
        if len(bounds):
            longer[new[leads] + 1] = np.minimum.reduceat(common, bounds)[::2] + 1
        common = longer
        spread = np.empty(total, np.int32)
        spread[old], spread[new] = owner, active
        owner = spread
        spread = np.empty(total, np.uint8)
        spread[old], spread[new] = size, j + 1
        size = spread
        held = merged & place_bits
        merged += np.flatnonzero(old)[held]
        merged -= held
        transform = merged
        place[active] = new
    return owner, size, common[:-1]


def least_ids(segments: list[bytes], ids: np.ndarray, length: int, width: int) -> np.ndarray:
    """For each segment and string in it, the least id among the segments that hold the string."""
    sizes = np.array([len(s) for s in segments], np.int64)
    owner, size, common = column_wise(np.frombuffer(b"".join(segments), np.uint8), np.cumsum(sizes) - sizes, sizes)
    least = np.full((len(segments), width), NEVER)
    if not len(owner):
        return least
    whole = size >= length
    runs = np.flatnonzero(common < length)
    known = np.where(whole, ids[owner], NEVER)
    best = np.repeat(np.minimum.reduceat(known, runs), np.diff(np.append(runs, len(owner))))
    least[owner[whole], sizes[owner[whole]] - size[whole]] = best[whole]
    return least


def _neighbours(data: np.ndarray, n: int, powers: tuple[np.ndarray, ...]) -> np.ndarray:
    """The sum that hashes every ``n`` neighbouring bytes, by doubling; the last n - 1 mean nothing."""
    table, up, _ = powers
    part, width, total, done = table[data], 1, np.zeros(len(data), np.uint64), 0
    while width <= n:
        if n & width:
            total[: len(total) - done] += part[done:] * up[done]
            done += width
        longer = part.copy()
        longer[:-width] += part[width:] * up[width]
        part, width = longer, 2 * width
    return total


def may_share(segments: list[bytes], anchor: np.ndarray, length: int, k: int) -> np.ndarray:
    """Which segments may share a string of ``length`` bytes with another one of the same anchor; never says no wrongly.

    Equal strings have their anchor at the same place. The anchor is the least gram of its segment, and stretches
    around it that are at most SLACK bytes shorter than a string lie so that every string holds one of them.
    """
    kept = np.zeros(len(segments), bool)
    if not len(segments):
        return kept
    powers, slack = _powers(), min(SLACK, length - k)
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    starts = np.cumsum(sizes) - sizes
    low = np.uint64(BLOCK - 1)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    least = _mixed(_neighbours(data, k, powers)) & ~low | place.astype(np.uint64)
    least[place + k > np.repeat(sizes, sizes)] = ~np.uint64(0)
    at = (np.minimum.reduceat(least, starts) & low).astype(np.int64)
    size = length - slack
    stretches = _neighbours(data, size, powers)
    for before in sorted({min(b, size - k) for b in range(0, length - k + 1, slack + 1)}):
        some = np.flatnonzero((at >= before) & (at - before + size <= sizes))
        key = stretches[starts[some] + at[some] - before]
        order = np.lexsort((key, anchor[some]))
        some, key = some[order], key[order]
        same = (anchor[some[1:]] == anchor[some[:-1]]) & (key[1:] == key[:-1])
        kept[some[1:][same]] = kept[some[:-1][same]] = True
    return kept


def _whole_anchors(anchor: np.ndarray, batch: int) -> list[tuple[int, int]]:
    """Parts of about ``batch`` segments that hold whole anchors; larger anchors than ``most`` were divided."""
    cuts = [0]
    while cuts[-1] < len(anchor):
        cuts.append(int(np.searchsorted(anchor, anchor[min(cuts[-1] + batch, len(anchor)) - 1], side="right")))
    return list(zip(cuts, cuts[1:], strict=False))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Bucket:
    """All digests of a range of anchor hashes."""

    def __init__(self, table: pa.Table) -> None:
        rows = table.sort_by("g").to_pylist()
        parts = [(np.frombuffer(r["hashes"], np.uint32), np.frombuffer(r["digests"], np.uint64), np.frombuffer(r["ids"], np.int64)) for r in rows]
        sizes = [len(h) for h, _, _ in parts]
        empty = (np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        hashes, digests, ids = (np.concatenate(x) for x in zip(empty, *parts, strict=True))
        group = np.repeat(np.array([r["g"] for r in rows], np.int64), sizes)
        entry = np.concatenate([np.zeros(0, np.int64), *(r["first"] + np.arange(n) for r, n in zip(rows, sizes, strict=True))])
        order = np.argsort(hashes, kind="stable")
        turn = np.flatnonzero(np.diff(hashes[order].astype(np.int64), prepend=-1))
        many = np.repeat(np.diff(np.append(turn, len(order))) > 1, np.diff(np.append(turn, len(order))))
        order = order[many]  # where an anchor has one digest of one group, the group knows all
        order = order[np.lexsort((group[order], digests[order], hashes[order]))]
        self.hashes, self.digests, self.ids, self.group, self.entry = (x[order] for x in (hashes, digests, ids, group, entry))
        n = len(order)
        new_hash = np.ones(n, bool)
        new_hash[1:] = self.hashes[1:] != self.hashes[:-1]
        self.new = new_hash.copy()
        self.new[1:] |= self.digests[1:] != self.digests[:-1]
        self.kind = np.cumsum(self.new) - 1  # number of the distinct digest
        self.anchor = np.cumsum(new_hash) - 1
        kinds = np.bincount(self.anchor[self.new])
        self.mixed = kinds[self.anchor] > 1 if n else np.zeros(0, bool)

    def wanted(self) -> np.ndarray:
        """Entries to ask for: the first of each digest where an anchor has several."""
        return np.flatnonzero(self.new & self.mixed)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where equal neighbours start and end; values are not negative."""
    turn = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    return list(zip(turn, [*turn[1:], len(values)], strict=True)) if turn else []


def _packed(group: np.ndarray, **columns: np.ndarray) -> dict[str, list]:
    """One row per group, with the bytes of its part of each column."""
    order = np.argsort(group, kind="stable")
    cuts = _runs(group[order])
    out = {"g": [int(group[order[a]]) for a, _ in cuts]}
    for name, values in columns.items():
        out[name] = [values[order[a:b]].tobytes() for a, b in cuts]
    return out


def with_kept_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 16,
    group_bytes: int = 4 << 20, bucket_bytes: int = 4 << 20, batch: int = 1024, most: int = 8192,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row.

    A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller id. What is
    compared is the input, also where it is removed. A missing text is empty; texts shorter than
    ``length`` stay whole. Rows with equal ids are equally early: neither removes from the other. Rows without an
    id come last and never remove from others. An empty table gives no rows.
    """
    if not k < length <= 64 + k - 1:
        raise ValueError("a segment must have at most 64 strings: k < length <= k + 63")
    width = length - k + 1
    source = slim(docs, id_col, text_col)
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = 1 + total // group_bytes, 1 + total // bucket_bytes
    frequent = frequent_anchors(source, length, k, most)
    dealt = source.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))

    def announce(table: pa.Table) -> pa.Table:
        group = Group(table, length, k, frequent)
        bucket = _bucket(group.hashes, buckets)
        cuts = _runs(bucket)
        low = group.hashes.astype(np.uint32)
        return pa.table({
            "b": pa.array([int(bucket[a]) for a, _ in cuts], pa.int64()), "g": pa.array([table.column("g")[0].as_py()] * len(cuts), pa.int64()),
            "first": pa.array([a for a, _ in cuts], pa.int64()),
            "hashes": pa.array([low[a:b].tobytes() for a, b in cuts], pa.binary()),
            "digests": pa.array([group.digest[a:b].tobytes() for a, b in cuts], pa.binary()),
            "ids": pa.array([group.least[a:b].tobytes() for a, b in cuts], pa.binary()),
        })

    entries = dealt.groupBy("g").applyInArrow(announce, "b bigint, g bigint, first bigint, hashes binary, digests binary, ids binary")

    def ask(table: pa.Table) -> pa.Table:
        bucket = Bucket(table)
        wanted = bucket.wanted()
        out = _packed(bucket.group[wanted], entries=bucket.entry[wanted].astype(np.uint32))
        return pa.table({"g": pa.array(out["g"], pa.int64()), "entries": pa.array(out["entries"], pa.binary())})

    requests = entries.groupBy("b").applyInArrow(ask, "g bigint, entries binary")

    def send(table: pa.Table, asked: pa.Table) -> pa.Table:
        kind = pa.schema([("b", pa.int64()), ("g", pa.int64()), ("entries", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
        if not asked.num_rows or not table.num_rows:
            return kind.empty_table()
        group = Group(table, length, k, frequent)
        chosen = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in asked.column("entries")]))
        sample = group.sample[chosen]
        sizes = group.count[sample] + length - 1
        starts = group.first[sample]
        bucket = _bucket(group.hashes[chosen], buckets)
        rows = []
        whole = group.data.tobytes()
        for a, b in _runs(bucket):
            spans = zip(starts[a:b].tolist(), sizes[a:b].tolist(), strict=True)
            rows.append((
                int(bucket[a]), table.column("g")[0].as_py(), chosen[a:b].tobytes(), sizes[a:b].astype(np.uint8).tobytes(),
                b"".join([whole[s : s + n] for s, n in spans]),
            ))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    segments = dealt.groupBy("g").cogroup(requests.groupBy("g")).applyInArrow(
        send, "b bigint, g bigint, entries binary, sizes binary, data binary"
    )

    def answer(table: pa.Table, sent: pa.Table) -> pa.Table:
        bucket = Bucket(table)
        earliest = np.minimum.reduceat(bucket.ids, np.flatnonzero(bucket.new)) if len(bucket.ids) else bucket.ids
        mask = np.where(earliest[bucket.kind] < bucket.ids, ~np.uint64(0), np.uint64(0)) if len(bucket.ids) else np.zeros(0, np.uint64)
        wanted = bucket.wanted()
        if len(wanted):
            content: dict[tuple[int, int], bytes] = {}
            for row in sent.to_pylist():
                at = 0
                for entry, size in zip(np.frombuffer(row["entries"], np.uint32).tolist(), row["sizes"], strict=True):
                    content[row["g"], entry] = row["data"][at : at + size]
                    at += size
            texts = [content[g, e] for g, e in zip(bucket.group[wanted].tolist(), bucket.entry[wanted].tolist(), strict=True)]
            anchor = bucket.anchor[wanted]
            shared = np.concatenate([may_share(texts[a:b], anchor[a:b], length, k) for a, b in _whole_anchors(anchor, 8 * batch)])
            # The strings of the others are known by the digest of their segment alone.
            turn = np.flatnonzero(shared)
            wanted, anchor = wanted[turn], anchor[turn]
            chosen = np.zeros(len(earliest), bool)
            chosen[bucket.kind[wanted]] = True
            rows = np.flatnonzero(chosen[bucket.kind])
            bits = np.uint64(1) << np.arange(width, dtype=np.uint64)
            for a, b in _whole_anchors(anchor, batch):
                kinds = bucket.kind[wanted[a:b]]
                least = least_ids([texts[t] for t in turn[a:b].tolist()], earliest[kinds], length, width)
                own = rows[np.searchsorted(bucket.anchor[rows], anchor[a]) : np.searchsorted(bucket.anchor[rows], anchor[b - 1], side="right")]
                local = np.searchsorted(kinds, bucket.kind[own])
                for i in range(0, len(own), 1 << 16):
                    some = own[i : i + (1 << 16)]
                    earlier = least[local[i : i + (1 << 16)]] < bucket.ids[some][:, None]
                    mask[some] = (earlier * bits).sum(axis=1, dtype=np.uint64)
        hit = np.flatnonzero(mask)
        out = _packed(bucket.group[hit], entries=bucket.entry[hit].astype(np.uint32), masks=mask[hit])
        return pa.table({"g": pa.array(out["g"], pa.int64()), "entries": pa.array(out["entries"], pa.binary()), "masks": pa.array(out["masks"], pa.binary())})

    answers = entries.groupBy("b").cogroup(segments.groupBy("b")).applyInArrow(answer, "g bigint, entries binary, masks binary")

    def finish(table: pa.Table, answered: pa.Table) -> pa.Table:
        kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
        if not table.num_rows:
            return kind.empty_table()
        found = [np.frombuffer(x.as_py(), np.uint32) for x in answered.column("entries")] if answered.num_rows else []
        masks = [np.frombuffer(x.as_py(), np.uint64) for x in answered.column("masks")] if answered.num_rows else []
        rows = Group(table, length, k, frequent).removed(
            np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate([np.zeros(0, np.uint64), *masks])
        )
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(
        finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )
