"""Packing against the other tokenizer library, an exact round trip, and a plain best fit."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from broodspark.llm import packing
from broodspark.llm.queries import token_files


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_files()[1])


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\na\n", "it's  we'll\tgo on", "x　 y   z ", "tab\t\tend\t ",
    "\x1c a\x1f b \x85c", "1234 5678\n 90", "emoji \U0001f600\U0001f1e9 ok", "你好 世界", "<|endoftext|> inside <|endoftext|>", "é é", "  lead", "trail  ",
    "a" * 5000, " ".join(["word"] * 5000), "​ ﻿ x", "'s 't 're", "...!!! ???", "\r\n line\r\nnext \r\n",
]


def test_ids_equal_those_of_the_library(tokenizer):
    encoder = packing.Encoder(*token_files(), remember=50)
    draw = random.Random(1)
    pieces = ["a", "B1", " ", "  ", "\n", "\t", "'ll", ".", "é", " ", "世", " ", "\x1d", "word", "_x"]
    mixed = ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 40))) for _ in range(2000)]
    for text in TEXTS + mixed:
        expected = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder(text) == expected, repr(text)


def test_tree_finds_the_tightest_window():
    draw = random.Random(2)
    tree, plain = packing.Capacities(100), []
    for step in range(3000):
        if draw.random() < 0.5:
            capacity = draw.randint(0, 100)
            tree.add(capacity, (step, 0))
            plain.append(capacity)
        else:
            length = draw.randint(0, 100)
            best = min((c for c in plain if c >= length), default=None)
            found = tree.take(length)
            assert (found and found[0]) == best or (found is None and best is None)
            if best is not None:
                plain.remove(best)


def check(rows, ids, window):
    whole, sequences = {}, {}
    for r in rows:
        assert 1 <= r.length <= window
        whole.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    for doc, expected in ids:
        parts = sorted((r.start, r.length, r.ids_crc32) for r in whole[doc, len(expected)])
        copies = len([1 for d, e in ids if d == doc and len(e) == len(expected)])
        assert sum(n for _, n, _ in parts) == copies * len(expected)
        for start, n, crc in parts:
            assert any(
                d == doc and zlib.crc32(np.array(e[start : start + n], "<u4").tobytes()) == crc for d, e in ids
            )
    return sequences


def test_packing_of_a_messy_table(messy, nothing, tokenizer):
    rows = packing.pack_documents(messy, *token_files(), window=64).collect()
    source = [(r.doc_id, r.text or "") for r in messy.select("doc_id", "text").collect()]
    check(rows, [(d, [*tokenizer.encode(t, add_special_tokens=False).ids, 0]) for d, t in source], 64)
    assert packing.pack_documents(nothing, *token_files()).count() == 0


def test_round_trip_and_little_padding(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack_documents(docs, *token_files(), with_ids=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    sequences = check(rows, [(d, [*tokenizer.encode(t, add_special_tokens=False).ids, 0]) for d, t in texts.items()], 1024)
    found = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        found.setdefault(r.doc_id, []).extend(r.ids)
    assert {d: tokenizer.decode(ids[:-1], skip_special_tokens=False) for d, ids in found.items()} == texts
    filled = [sum(r.length for r in parts) for parts in sequences.values()]
    padding = sum(1024 - n for n in filled if n & (n - 1))
    assert padding < 0.03 * sum(filled)
