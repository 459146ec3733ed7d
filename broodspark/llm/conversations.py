"""Repair of the structure of conversations: the cheapest edits that give (system) (user assistant)...

A node of the edit lattice is a number of rows read and the last role written; edits are its edges. The search is a bidirectional
Dijkstra: a forward and a reverse heap meet, go on until all crossings of the least cost are known, and
the least audit of all paths through them is read off from the start.

Conversations of common size are sorted together and repaired where they lie. Large ones are divided: rows that are equal
are counted first, the others are sorted over all tasks, and each task gives, for its segment of a conversation, the cost
between every two roles and the order of the audits. One task per conversation chooses among those few numbers; then the segments write
their repaired turns in blocks, and only the checksum reads a conversation as a whole, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodspark.llm.common import checkpointed

BLANKS = " \t\n\x0b\f\r"
ENDS = ".!?"
#: Last role written: none, system, user, assistant. Rows that may follow, by initial, and what an edit writes there.
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (2, 2, 3, 2)
WRITES = (None, None, "user", "assistant")
ENDS_WELL = (0, 3)
INSERT, DELETE, REROLE, CUT = 5, 2, 1, 5
LARGE_ROWS, LARGE_BYTES, MOST_LARGE = 20_000, 32 << 20, 100_000
BLOCK = 1 << 20

Edge = tuple[str, int, int]


def edges(codes: str, node: int, insert_last: bool) -> list[Edge]:
    """(edit, cost, node after) in the order of the letters. A node is four times the rows read plus the last role.

    A code is the initial of a row, in upper case if it ends in the middle of a sentence, or x if it must go.
    """
    at, role = divmod(node, 4)
    end = len(codes)
    if at == end:
        return [("I", INSERT, 4 * at + NEXT[role])] if insert_last else []
    code = codes[at]
    out = [("D", DELETE, node + 4), ("I", INSERT, 4 * at + NEXT[role])]
    if code != "x":
        cut = CUT if code.isupper() or code == "_" else 0
        to = FOLLOWS[role].get(code.lower())
        if to is not None:
            out.append(("K", cut, 4 * at + 4 + to))
        out.append(("R", REROLE + cut, 4 * at + 4 + NEXT[role]))
    return out


def edges_into(codes: str, node: int, insert_last: bool) -> list[tuple[int, int]]:
    """(cost, node before) of all edges that end in the node."""
    at, role = divmod(node, 4)
    before = [4 * at + r for r in range(4)] if role > 1 else []
    before += [node - 4] if at and role < 2 else [4 * (at - 1) + r for r in range(4)] if at else []
    if at and role == 1:
        before.append(4 * (at - 1))
    return [(cost, b) for b in before for _, cost, to in edges(codes, b, insert_last) if to == node]


def cheapest(codes: str, start: int = 0, ends: tuple[int, ...] = ENDS_WELL, insert_last: bool = True) -> tuple[int, str] | None:
    """Cost and least audit from a last role to one of the last roles after all rows; None if there is no way."""
    begin, goals = start, [4 * len(codes) + r for r in ends]
    there: dict[int, int] = {begin: 0}
    back: dict[int, int] = dict.fromkeys(goals, 0)
    heap, paeh = [(0, begin)], [(0, g) for g in goals]
    settled: set[int] = set()
    best = 0 if begin in back else None
    while heap and paeh and (best is None or heap[0][0] + paeh[0][0] <= best):
        if heap[0][0] <= paeh[0][0]:
            cost, node = heappop(heap)
            if cost > there[node] or node in settled:
                continue
            settled.add(node)
            steps, known, other, into = [(c, to) for _, c, to in edges(codes, node, insert_last)], there, back, heap
        else:
            cost, node = heappop(paeh)
            if cost > back[node]:
                continue
            steps, known, other, into = edges_into(codes, node, insert_last), back, there, paeh
        for more, to in steps:
            total = cost + more
            if total < known.get(to, total + 1):
                known[to] = total
                heappush(into, (total, to))
                if to in other and (best is None or total + other[to] < best):
                    best = total + other[to]
    if best is None:
        return None
    # Nodes of the forward search that lead to a crossing of the least cost.
    crossings = [n for n, cost in there.items() if n in back and cost + back[n] == best]
    leads, todo = set(crossings), crossings
    while todo:
        node = todo.pop()
        for cost, before in edges_into(codes, node, insert_last):
            if before in settled and before not in leads and there[before] + cost == there[node]:
                leads.add(before)
                todo.append(before)
    audit, node, cost = [], begin, 0
    while not (node in goals and cost == best):
        for edit, more, to in edges(codes, node, insert_last):
            total = cost + more
            if (to in back and total + back[to] == best) or (to in leads and there[to] == total):
                audit.append(edit)
                node, cost = to, total
                break
    return best, "".join(audit)


class Solver:
    """Remembers what was found for the codes of short conversations, up to a bound."""

    def __init__(self, remember: int = 200_000) -> None:
        self.remember, self.known = remember, {}

    def __call__(self, codes: str) -> tuple[int, str]:
        found = self.known.get(codes)
        if found is None:
            found = cheapest(codes)
            if len(codes) <= 64:
                if len(self.known) >= self.remember:
                    self.known.clear()
                self.known[codes] = found
        return found


def code(role: str, text: str, seen: bool) -> tuple[str, str]:
    """Code and fault of a row: b(lank), d(uplicate), t(runcated) or none."""
    last = text.rstrip(BLANKS)[-1:]
    if not last:
        return "x", "b"
    if seen:
        return "x", "d"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
    if last in ENDS:
        return initial, ""
    return {"-": "_"}.get(initial, initial.upper()), "t"


def turns(rows: Iterable[tuple[str, str]], audit: str, role: int = 0) -> list[tuple[str, str]]:
    """(role, text) of the repaired rows, beginning after the given last role."""
    out, at = [], iter(rows)
    for edit in audit:
        if edit == "I":
            role = NEXT[role]
            out.append((WRITES[role], ""))
            continue
        said, text = next(at)
        if edit == "K":
            role = FOLLOWS[role][said[0]]
            out.append((said, text))
        elif edit == "R":
            role = NEXT[role]
            out.append((WRITES[role], text))
    return out


def _legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


def _order(*columns: str) -> list[Column]:
    return [F.asc_nulls_first(c) for c in columns]


def _rows(talks: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return talks.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"),
    )


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Neighbouring rows of equal first columns: those columns, and the rest of each row."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _batches(rows: Iterator[tuple], schema: T.StructType, at_once: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)

    def batch(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kind, strict=True)], schema=kind)

    some, size = [], 0
    for row in rows:
        some.append(row)
        size += 200 + sum(len(c) for c in row if isinstance(c, str))
        if size > at_once:
            yield batch(some)
            some, size = [], 0
    if some:
        yield batch(some)


def _schema(talks: DataFrame, text: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", talks.schema["conv_id"].dataType), *T.StructType.fromDDL(text).fields])


SUMMARY = (
    "n_rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
)
TURNS = "segment bigint, block bigint, position bigint, role string, text string"


def _read(rows: list[tuple]) -> tuple[str, list[str]]:
    """Codes and faults of a whole conversation of (turn, role, text)."""
    seen: set[tuple[str, str]] = set()
    codes, faults = [], []
    for _, role, text in rows:
        c, fault = code(role, text, (role, text) in seen)
        seen.add((role, text))
        codes.append(c)
        faults.append(fault)
    return "".join(codes), faults


def _line(rows: list[tuple[str, str]]) -> str:
    return "\n".join([f"{role}:{text}" for role, text in rows])


def _whole(key: tuple, rows: list[tuple], solve: Solver) -> tuple:
    codes, faults = _read(rows)
    cost, audit = solve(codes)
    numbers = [turn for turn, _, _ in rows if turn is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(not _legal(a[1], b[1]) for a, b in zip(rows, rows[1:], strict=False))
    done = _line(turns([r[1:] for r in rows], audit))
    count = faults.count
    return (*key, len(rows), gaps, count("b"), count("d"), count("t"), illegal, cost, audit, hashlib.sha256(done.encode()).hexdigest())


def _sorted(rows: DataFrame) -> DataFrame:
    hashed = rows.withColumn("hash", F.xxhash64("text")).repartition("conv_id")
    return hashed.sortWithinPartitions(*_order("conv_id", "turn", "role", "hash", "text")).select(*rows.columns)


def _common(rows: DataFrame) -> DataFrame:
    """One row per conversation that fits a task; the rows of a conversation lie together."""
    schema = _schema(rows, SUMMARY)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = Solver()
        yield from _batches((_whole(key, group, solve) for key, group in _groups(batches, 1)), schema)

    return _sorted(rows).mapInArrow(repair, schema)


def _common_turns(rows: DataFrame) -> DataFrame:
    schema = _schema(rows, TURNS)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = Solver()

        def each():
            for key, group in _groups(batches, 1):
                done = turns([r[1:] for r in group], solve(_read(group)[0])[1])
                yield from ((*key, 0, 0, n, role, text) for n, (role, text) in enumerate(done))

        yield from _batches(each(), schema)

    return _sorted(rows).mapInArrow(repair, schema)


def _large(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Hashes of the largest conversations beyond a size, at most MOST_LARGE of them; smaller ones with the same hash may join them."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    beyond = sizes.filter((F.col("n") > most_rows) | (F.col("bytes") > most_bytes))
    return beyond.orderBy(F.desc("bytes")).limit(MOST_LARGE).select(F.xxhash64("conv_id").alias("_large")).distinct()


def _segmented(rows: DataFrame) -> DataFrame:
    """Rows in order over all tasks: conv_id, segment, turn, role, text, n (equal rows), seen (earlier in the conversation).

    Equal rows are counted before anything is sorted, so no value of the sort key can fill a task.
    """
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    counted = checkpointed(counted.withColumn("digest", F.sha2("text", 256)))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("later"), "turn"))["turn"].alias("first_turn")
    firsts = counted.groupBy("conv_id", "role", "digest").agg(first, F.count("*").alias("places")).filter("places > 1")
    firsts = firsts.select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")), "first_turn", F.lit(True).alias("again"))
    joined = counted.join(
        firsts, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left"
    )
    seen = F.col("again").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    key = _order("conv_id", "turn", "role", "hash")
    hashed = joined.withColumn("seen", seen).withColumn("hash", F.xxhash64("text"))
    ordered = hashed.repartitionByRange(*key).sortWithinPartitions(*key, "text")
    return checkpointed(ordered.select("conv_id", F.spark_partition_id().cast("bigint").alias("segment"), "turn", "role", "text", "n", "seen"))


def _codes(rows: list[tuple]) -> tuple[str, dict[str, int]]:
    """Codes and numbers of faults of a segment of (turn, role, text, n, seen); equal rows go but for the first."""
    codes, faults = [], {"b": 0, "d": 0, "t": 0, "": 0}
    for _, role, text, n, seen in rows:
        c, fault = code(role, text, seen)
        codes.append(c + "x" * (n - 1))
        faults[fault] += 1
        faults["b" if fault == "b" else "d"] += n - 1
    return "".join(codes), faults


PARTS = (
    "segment bigint, n_rows bigint, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first_role string, last_role string, costs array<bigint>, ranks array<bigint>"
)


def _part(key: tuple, rows: list[tuple]) -> tuple:
    """What the choice needs to know of a segment: for every two roles the cost, and the place of the audit among those from the first role.

    No insertion after the last row: the next segment makes it. So no audit is the beginning of another.
    """
    codes, faults = _codes(rows)
    costs, ranks = [], []
    for start in range(4):
        found = [cheapest(codes, start, (end,), insert_last=False) for end in range(4)]
        order = sorted(audit for f in found if f for audit in f[1:])
        costs += [f[0] if f else None for f in found]
        ranks += [order.index(f[1]) if f else None for f in found]
    numbers = [r[0] for r in rows if r[0] is not None]
    illegal = sum(not _legal(a[1], b[1]) for a, b in zip(rows, rows[1:], strict=False)) + sum(r[3] - 1 for r in rows)
    return (
        *key, len(codes), min(numbers, default=None), max(numbers, default=None), len(set(numbers)), faults["b"], faults["d"], faults["t"],
        illegal, rows[0][1][:1], rows[-1][1][:1], costs, ranks,
    )


def choose(parts: list[tuple]) -> tuple[tuple, list[tuple[int, int, int]], str]:
    """Of the segments of a conversation in order: its numbers, (segment, first, last role) of each, and the insertions at its end."""
    after = [cheapest("", role) for role in range(4)]
    left = [[a[0] for a in after]]
    for *_, costs, _ in reversed(parts):
        left.append([min(c + left[-1][e] for e, c in enumerate(costs[4 * s : 4 * s + 4]) if c is not None) for s in range(4)])
    left.reverse()
    role, chosen = 0, []
    for n, (segment, *_, costs, ranks) in enumerate(parts):
        _, to = min(
            (ranks[4 * role + e], e) for e in range(4)
            if costs[4 * role + e] is not None and costs[4 * role + e] + left[n + 1][e] == left[n][role]
        )
        chosen.append((segment, role, to))
        role = to
    known = [p for p in parts if p[2] is not None]
    low, high = min((p[2] for p in known), default=0), max((p[3] for p in known), default=-1)
    shared = sum(a[3] == b[2] for a, b in zip(known, known[1:], strict=False))
    gaps = high - low + 1 - (sum(p[4] for p in parts) - shared)
    between = sum(not _legal(a[10], b[9]) for a, b in zip(parts, parts[1:], strict=False))
    sums = [sum(p[i] for p in parts) for i in (1, 5, 6, 7, 8)]
    return (sums[0], gaps, *sums[1:4], sums[4] + between, left[0][0]), chosen, after[role][1]


def _divided(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of large conversations: their numbers with the last insertions, and their repaired turns in blocks, in order."""
    ordered = _segmented(rows)
    parts_kind = _schema(rows, PARTS)
    choice_kind = _schema(rows, "n_rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, tail string, "
                                "chosen array<struct<segment: bigint, entry: bigint, goal: bigint>>")  # fmt: skip

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((_part(key, group) for key, group in _groups(batches, 2)), parts_kind)

    def choice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for key, group in _groups(batches, 1):
                numbers, chosen, tail = choose(group)
                yield (*key, *numbers, tail, [{"segment": s, "entry": a, "goal": b} for s, a, b in chosen])

        yield from _batches(each(), choice_kind)

    parts = ordered.mapInArrow(part, parts_kind).repartition("conv_id").sortWithinPartitions(*_order("conv_id", "segment"))
    choices = checkpointed(parts.mapInArrow(choice, choice_kind))
    # A row per segment: at most one per task and conversation.
    ways = choices.select(F.col("conv_id").alias("_conv_id"), F.inline("chosen")).withColumnRenamed("segment", "_segment")
    marked = ordered.join(
        F.broadcast(ways), F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("segment") == F.col("_segment"))
    ).select("conv_id", "segment", "entry", "goal", "turn", "role", "text", "n", "seen")
    blocks_kind = _schema(rows, "segment bigint, block bigint, audit string, turns array<struct<role: string, text: string>>")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for (conv, segment, entry, goal), group in _groups(batches, 4):
                _, audit = cheapest(_codes(group)[0], entry, (goal,), insert_last=False)
                said = ((role, text) for _, role, text, n, _ in group for _ in range(n))
                some, size, block = [], 0, 0
                for role, text in turns(said, audit, entry):
                    some.append({"role": role, "text": text})
                    size += len(text)
                    if size > BLOCK:
                        yield conv, segment, block, audit, some
                        some, size, block, audit = [], 0, block + 1, ""
                if some or audit:
                    yield conv, segment, block, audit, some

        yield from _batches(each(), blocks_kind, at_once=1)

    return choices, marked.mapInArrow(write, blocks_kind)


def _divided_summary(rows: DataFrame) -> DataFrame:
    choices, blocks = _divided(rows)
    schema = _schema(rows, SUMMARY)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    numbers = ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = [F.lit(None).cast("bigint").alias(c) for c in numbers]
    # The conversation's own row comes last, with the insertions at its end.
    tail = F.when(F.col("tail") == "I", "assistant:").when(F.col("tail") == "II", "user:\nassistant:").otherwise("")
    both = blocks.select("conv_id", "segment", "block", "audit", lines.alias("lines"), *nothing).union(
        choices.select("conv_id", F.lit(1 << 62).alias("segment"), F.lit(0).alias("block"), F.col("tail").alias("audit"), tail.alias("lines"), *numbers)
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            digest, audits, empty = hashlib.sha256(), [], True
            for batch in batches:
                for conv, _, _, audit, lines, *numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    audits.append(audit)
                    if lines:
                        digest.update((lines if empty else f"\n{lines}").encode())
                        empty = False
                    if numbers[0] is not None:
                        yield conv, *numbers, "".join(audits), digest.hexdigest()
                        digest, audits, empty = hashlib.sha256(), [], True

        yield from _batches(each(), schema)

    return both.repartition("conv_id").sortWithinPartitions(*_order("conv_id", "segment", "block")).mapInArrow(hashed, schema)


def _by_size(rows: DataFrame, common: Callable, divided: Callable, most_rows: int, most_bytes: int) -> DataFrame:
    large = checkpointed(_large(rows, most_rows, most_bytes))
    if large.isEmpty():
        return common(rows)
    marked = rows.withColumn("_hash", F.xxhash64("conv_id"))
    sides = [marked.join(F.broadcast(large), F.col("_hash") == F.col("_large"), how).select(*rows.columns) for how in ("left_anti", "left_semi")]
    return common(sides[0]).union(divided(sides[1]))


def repaired(
    talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    large_rows: int = LARGE_ROWS, large_bytes: int = LARGE_BYTES,
) -> DataFrame:
    """One row per conversation: conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, missing turns first; rows of one turn by role, hash of the text and text, so equal rows are neighbours. A missing role or text
    counts as one blank, rows without a conversation as one conversation. The first fault of a row counts: blank, duplicate (role and text came earlier),
    truncated (no ``.!?`` at the end). Edits: K(eep) 0, R(erole) 1, D(elete) 2, I(nsert) 5; blank and duplicate rows
    must go, a truncated row that stays costs 5 more. Of the cheapest audits the least one holds. ``gaps`` are the missing turns, ``illegal`` the
    neighbours that are not system-user, user-assistant or assistant-user. An empty table gives no rows; other columns are not read.

    Conversations beyond ``large_rows`` rows or ``large_bytes`` bytes are divided over all tasks; the result is the same.
    """
    rows = _rows(talks, conv_col, turn_col, role_col, text_col)
    return _by_size(rows, _common, _divided_summary, large_rows, large_bytes)


def repaired_turns(
    talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    large_rows: int = LARGE_ROWS, large_bytes: int = LARGE_BYTES,
) -> DataFrame:
    """The repaired rows: conv_id, segment, block, position, role, text; a conversation is ordered by those three numbers."""
    def divided(some: DataFrame) -> DataFrame:
        choices, blocks = _divided(some)
        written = blocks.select("conv_id", "segment", "block", F.posexplode("turns").alias("position", "t"))
        roles = F.when(F.col("tail") == "I", F.array(F.lit("assistant"))).when(F.col("tail") == "II", F.array(F.lit("user"), F.lit("assistant")))
        tail = choices.select("conv_id", F.lit(1 << 62).alias("segment"), F.lit(0).cast("bigint").alias("block"), F.posexplode(roles).alias("position", "role"))
        return written.select("conv_id", "segment", "block", "position", "t.role", "t.text").union(tail.withColumn("text", F.lit("")))

    rows = _rows(talks, conv_col, turn_col, role_col, text_col)
    return _by_size(rows, _common_turns, divided, large_rows, large_bytes)


def with_all(found: DataFrame, talks: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The result for every conversation of ``talks``; one that has no rows left has zeros and an empty audit."""
    named = found.withColumnRenamed("conv_id", "_conv_id")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    all_of = talks.select(F.col(conv_col).alias("conv_id")).distinct()
    return all_of.join(named, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def with_damage(talks: DataFrame) -> DataFrame:
    """Test damage of (conv_id, turn, role, text) by the CRC-32 of ``conv_id:turn`` modulo 20; missing values count as one blank.

    0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it a user's.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    h = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    damaged = F.when(h == 1, "").when(h == 2, F.translate(text("text"), ENDS, "")).otherwise(text("text"))
    rows = talks.filter(h != 0).select("conv_id", "turn", F.when(h == 4, "user").otherwise(text("role")).alias("role"), damaged.alias("text"), h.alias("h"))
    return rows.withColumn("copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("h", "copy")
