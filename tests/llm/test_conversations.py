"""Conversation repair against a plain search over all edits, whole and divided."""

import hashlib
import random
import zlib

import pytest

from broodspark.llm import conversations
from broodspark.llm.queries import QUERIES

WRITTEN = {"u": "user", "a": "assistant"}
FOLLOW = {"": "su", "s": "u", "u": "a", "a": "u"}


def best(rows):
    """(cost, audit, repaired) of (role, text, must go, truncated), by a table over all rows and last roles."""
    def keep(table, role, found):
        if role not in table or found[:2] < table[role][:2]:
            table[role] = found

    def written(last, role):
        return role in FOLLOW[last] and role != "s"

    table = {"": (0, "", ())}
    for at in range(len(rows) + 1):
        for _ in range(3):
            for last, (cost, audit, out) in list(table.items()):
                for role in "ua":
                    if written(last, role):
                        keep(table, role, (cost + 5, audit + "I", (*out, f"{WRITTEN[role]}:")))
        if at == len(rows):
            return min(table[last] for last in ("", "a") if last in table)
        said, text, must, cut = rows[at]
        after = {}
        for last, (cost, audit, out) in table.items():
            keep(after, last, (cost + 2, audit + "D", out))
            if not must:
                if said[:1] and said[0] in FOLLOW[last]:
                    keep(after, said[0], (cost + 5 * cut, audit + "K", (*out, f"{said}:{text}")))
                for role in "ua":
                    if written(last, role):
                        keep(after, role, (cost + 1 + 5 * cut, audit + "R", (*out, f"{WRITTEN[role]}:{text}")))
        table = after


def plain(rows):
    """The row of one conversation of (turn, role, text) in order."""
    seen, marked, count = set(), [], {"b": 0, "d": 0, "t": 0}
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        marked.append((role, text, fault in ("b", "d"), fault == "t"))
    cost, audit, out = best(marked)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, count["b"], count["d"], count["t"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def by_id(frame):
    rows = frame.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def test_search_gives_the_least_audit_of_the_cheapest():
    rnd = random.Random(5)
    for _ in range(3000):
        codes = "".join(rnd.choice(rnd.choice(["suaSUAx-_", "ua", "uaUx"])) for _ in range(rnd.randrange(10)))
        rows = [(c.lower().replace("_", "-"), "t", c == "x", c.isupper() or c == "_") for c in codes]
        assert conversations.cheapest(codes) == best(rows)[:2], codes


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if h == 1 else text.translate({ord(c): None for c in ".!?"}) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def test_query_equals_the_plain_search(spark, sf_dir):
    talks = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = {}
    for conv, turn, role, text in damaged(talks):
        by.setdefault(conv, []).append((turn, role, text))
    want = {c: plain(sorted(by.get(c, []), key=lambda r: (r[0] is not None, r[0]))) for c in {t[0] for t in talks}}
    assert by_id(QUERIES["op13_conversation_repair"](spark, sf_dir)) == want


@pytest.fixture(scope="module")
def talks(spark):
    rnd = random.Random(7)
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rnd.randrange(1, 40)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No!", "what", "", " \n", None, f"text {rnd.randrange(9)}.", " ", "é?  "])
            rows.append((conv, None if rnd.random() < 0.1 else 3 * turn // 2, role, text, "x"))
    # A conversation that is the same row again and again, and one with few different ones.
    rows += [(50, None, "user", "Same.", "x")] * 300 + [(51, t % 7, "user", f"Text {t % 5}.", "x") for t in range(300)]
    rows += [(52, t, ("user", "assistant")[t % 2], "long " * 400 + f"{t}.", "x") for t in range(60)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, hash string").repartition(3)


def test_divided_conversations_give_the_same(spark, talks):
    whole = by_id(conversations.repaired(talks))
    assert by_id(conversations.repaired(talks, large_rows=10)) == whole
    assert by_id(conversations.repaired(talks, large_bytes=2000)) == whole
    same = whole[50]
    assert same[:7] == (0, 0, 299, 0, 299, 2 * 300, "D" * 300)


def test_turns_are_those_of_the_checksum(spark, talks):
    whole = by_id(conversations.repaired(talks))
    for size in ({}, {"large_rows": 10}):
        rows = conversations.repaired_turns(talks, **size).orderBy("segment", "block", "position").collect()
        for conv, found in whole.items():
            text = "\n".join(f"{r.role}:{r.text}" for r in rows if r.conv_id == conv)
            assert hashlib.sha256(text.encode()).hexdigest() == found[7], (conv, size)


def test_rows_without_ties_equal_the_plain_search(spark, talks):
    rows = [tuple(r) for r in talks.dropDuplicates(["conv_id", "turn"]).select("conv_id", "turn", "role", "text").collect()]
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = {c: plain(sorted(r, key=lambda r: (r[0] is not None, r[0]))) for c, r in by.items()}
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert by_id(conversations.repaired(frame)) == want
    assert by_id(conversations.repaired(frame, large_rows=5)) == want


def test_empty_table_and_conversation_without_rows(spark, talks):
    assert conversations.repaired(talks.filter("false")).count() == 0
    gone = conversations.with_all(conversations.repaired(talks.filter("conv_id = 3")), talks.filter("conv_id IN (3, 50)"))
    assert by_id(gone)[50] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
