"""Byte-level BPE against the library, and periodic runs against a scan of all lags."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from broodspark.llm import byte_bpe, periodic
from broodspark.llm.queries import QUERIES, token_files


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files()[1])


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(token_files()[1])


def same(library, vocabulary, texts, remember=300_000):
    encoder = byte_bpe.Encoder(vocabulary, remember)
    for some in (texts[: len(texts) // 2], texts[len(texts) // 2 :]):
        for text, found in zip(some, encoder(some), strict=True):
            ids = np.frombuffer(found, "<i4")
            want = library.encode(text or "", add_special_tokens=False).ids
            assert ids.tolist() == want, text
            assert vocabulary.decode(ids).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_every_character(library, vocabulary):
    texts = [f"a{chr(c)} b{chr(c)}{chr(c)}1 {chr(c)}x\n{chr(c)}" for c in [*range(1, 0xD800, 3), *range(0xE000, 0x20000, 7)]]
    same(library, vocabulary, texts)


def test_random_and_long_texts(library, vocabulary):
    rnd = random.Random(3)
    letters = "aabbcdeéß你 好\n\t  '’sSt12٣-—=😀  \x1c\x85​ 　"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(80))) for _ in range(1500)]
    texts += [None, "", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext|> ", "a" * 20_000, "ab" * 5000 + " " * 3000]
    texts += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000)), "don't we'll I'M 'sup' ''s"]
    same(library, vocabulary, texts)
    same(library, vocabulary, texts, remember=20)


def test_decoding_any_ids(library, vocabulary):
    rnd = random.Random(4)
    for n in (0, 1, 5, 600_000):
        ids = [rnd.randrange(-3, 50_300) for _ in range(n)]
        assert vocabulary.decode(np.array(ids, int)).decode("utf-8", "replace") == library.decode([i for i in ids if i >= 0], skip_special_tokens=False)


def test_encoding_messy_tables(spark, messy, nothing, library):
    file = token_files()[1]
    rows = byte_bpe.with_decoded(byte_bpe.with_ids(messy, file, into="kept"), file, "kept", into="score").collect()
    assert len(rows) == messy.count()
    for r in rows:
        assert r.kept == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.score == (r.text or "")
    assert byte_bpe.with_decoded(byte_bpe.with_ids(nothing, file), file).count() == 0
    odd = spark.createDataFrame([(None,), ([None, 72, 99999],), ([],)], "ids array<int>")
    assert [r.decoded for r in byte_bpe.with_decoded(odd, file).collect()] == ["", library.decode([72]), ""]


def test_encoding_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op11_byte_bpe"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_other_files_are_refused(tmp_path):
    import json

    stored = json.load(open(token_files()[1], encoding="utf-8"))
    stored["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(stored))
    with pytest.raises(ValueError, match="not a plain"):
        byte_bpe.Vocabulary(str(tmp_path / "other.json"))


def plain_runs(words):
    """Every lag, every stretch, every smaller period."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(12, 2 * q):
                part = words[s : s + length]
                if not any(part[r:] == part[: length - r] for r in range(1, q)):
                    out.append((s, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    again = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in again).decode()


def test_runs_equal_a_scan_of_all_lags():
    rnd = random.Random(1)
    for turn in range(1500):
        kinds, n = rnd.choice([1, 2, 3, 4, 6, 20, 100]), rnd.choice([0, 5, 11, 12, 13, 24, 40, 80, 150])
        words = [b"%d" % rnd.randrange(kinds) for _ in range(n)]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(words) + 1)
            words[at:at] = words[at : at + rnd.randrange(1, 10)] * rnd.randrange(1, 8)
        if turn % 50 == 0:
            a, b = [b"a"], [b"a", b"b"]
            for _ in range(rnd.randrange(3, 9)):
                a, b = b, b + a
            words = b
        texts = [words, [b"x"] * rnd.randrange(30), words[::-1]]
        for text, runs in zip(texts, periodic.runs_of(texts), strict=True):
            assert runs == plain_runs(text)
            assert periodic.collapsed(text, runs) == plain_collapse(text, runs)


def test_splitting_leaves_only_repeated_words():
    words = np.array([*range(100), *[1, 2, 3] * 5, *range(200, 260)])
    assert [(a, b) for a, b in periodic.surviving(words, np.zeros(len(words), int))] == [(100, 115)]
    assert periodic.surviving(np.array([1] * 12), np.repeat([0, 1], 6)) == []


def test_long_periods_and_many_lags():
    rnd = random.Random(2)
    part = [b"%d" % rnd.randrange(900) for _ in range(4000)]
    assert periodic.runs_of([part * 3])[0] == [(0, 12_000, 4000)]
    assert periodic.runs_of([[b"x"] * 50_000])[0] == [(0, 50_000, 1)]


def test_runs_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op12_periodic_runs"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        words = (texts[r.doc_id] or "").encode().split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words) if n < 400 else periodic.runs_of([words])[0]
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (top or (None,) * 3)
        assert r.exponent_milli == (top and 1000 * top[1] // top[2])


def test_runs_of_messy_tables(messy, nothing):
    rows = periodic.with_runs(messy, into="spans").collect()
    assert len(rows) == messy.count()
    assert all(r.spans.n_words == len((r.text or "").encode().split()) for r in rows)
    assert all(r.spans.collapsed == "" for r in rows if not (r.text or "").strip())
    assert periodic.with_runs(nothing).count() == 0
    damaged = periodic.with_repeated_tails(messy.select("doc_id", "text")).collect()
    assert len(damaged) == len(rows) and sum(r.text is None for r in damaged) == sum(r.text is None for r in rows)
