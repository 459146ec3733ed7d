"""Exact copies, near copies and long repeated strings against plain versions."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from broodspark.llm import exact_dedup, simhash, suffix_dedup


def plain_copies(rows, largest):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for text, docs in groups.items():
        known = [d for d in docs if d is not None]
        keep = (max(known) if largest else min(known)) if known else None
        out += [(d, keep, len(docs), hashlib.sha256(text.encode()).hexdigest()) for d in docs]
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("hot_rows", [1, 2, 256])
def test_copies_of_a_messy_table(messy, keep, hot_rows):
    marked = exact_dedup.mark_copies(messy, keep=keep, hot_rows=hot_rows)
    assert set(messy.columns) <= set(marked.columns)
    rows = marked.select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()
    source = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:4] for r in rows), key=str) == plain_copies(source, keep == "largest")
    assert sum(r.kept for r in rows) == len({t or "" for _, t in source})
    kept = exact_dedup.drop_copies(messy, keep=keep, hot_rows=hot_rows)
    assert kept.columns == messy.columns and kept.count() == len({t or "" for _, t in source})


def test_hot_copies_are_split(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i}") for i in range(300)], "doc_id bigint, text string")
    rows = exact_dedup.mark_copies(docs, keep="largest", hot_rows=16).collect()
    assert {(r.keep_id, r.group_size) for r in rows if r.text == "hot"} == {(299, 200)}
    assert [r.doc_id for r in rows if r.kept and r.text == "hot"] == [299]


def test_copies_of_an_empty_table(nothing):
    assert exact_dedup.mark_copies(nothing).count() == 0


def test_exact_plan_is_native(messy):
    plan = exact_dedup.mark_copies(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rangepartitioning" in plan


def plain_fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c == " " or 9 <= ord(c) <= 13:
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, radius=3):
    ids = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                a, b = ids[i], ids[j]
                ids = [min(a, b) if x in (a, b) else x for x in ids]
    out = []
    for i, (doc, fp) in enumerate(rows):
        known = [d for (d, _), x in zip(rows, ids, strict=True) if x == ids[i] and d is not None]
        out.append((doc, fp, min(known) if known else None))
    return sorted(out, key=str)


def test_fingerprint_is_the_native_hash(spark):
    text = "One ÉTUDE in\x0bRed"
    native = spark.sql("SELECT xxhash64('one Étude in') AS a, xxhash64('Étude in red') AS b").first()
    both = [native.a % 2**64, native.b % 2**64]
    assert simhash.fingerprint(text) == plain_fingerprint(text) == both[0] & both[1]


def test_near_groups_of_a_messy_table(messy):
    rows = simhash.near_groups(messy).collect()
    source = [(r.doc_id, plain_fingerprint(r.text)) for r in messy.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in rows), key=str) == plain_groups(source)
    one = simhash.keep_one_per_group(messy)
    assert one.columns == messy.columns and one.select("doc_id").distinct().count() == len({c for _, _, c in plain_groups(source)})


def test_links_of_many_fingerprints(spark):
    """Chains and dense clouds within and across tiles, against all pairs."""
    draw = random.Random(3)
    fps = {0, 2**64 - 1}
    for _ in range(60):
        at = draw.getrandbits(64)
        for _ in range(draw.randint(1, 20)):
            at ^= 1 << draw.randrange(64) | 1 << draw.randrange(64)
            fps.add(at)
    fps |= {7 << 20 | 1 << b | 1 << c for b in range(12) for c in range(12)}
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    star = {r.node % 2**64: r.root % 2**64 for r in simhash.stars(simhash.tile_links(nodes, 3, tile=16)).collect()}
    found, wanted = {}, {}
    for f in fps:
        found.setdefault(star.get(f, f), set()).add(f)
    for _, f, c in plain_groups([(i, f) for i, f in enumerate(sorted(fps))]):
        wanted.setdefault(c, set()).add(f)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_a_dense_group_gives_few_links(spark):
    nodes = spark.createDataFrame([(1 << a | 1 << b,) for a in range(40) for b in range(a)], "fp bigint")
    links = simhash.tile_links(nodes, 4, tile=2048)
    assert links.count() < 20 * nodes.count()


def test_near_groups_of_an_empty_table(nothing):
    assert simhash.near_groups(nothing).count() == 0
    assert simhash.keep_one_per_group(nothing).count() == 0


def plain_kept(rows, length):
    first = {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for doc, text in order:
        data = text.encode()
        for p in range(len(data) - length + 1):
            first.setdefault(data[p : p + length], doc)
    out = []
    for doc, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            before = first[data[p : p + length]]
            if before is not None and (doc is None or before < doc):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone, strict=True) if not g)))
    return sorted(out, key=str)


def run_kept(docs, **options):
    rows = suffix_dedup.with_kept_bytes(docs, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=str)


def test_kept_bytes_of_a_messy_table(messy):
    source = [(r.doc_id, r.text or "") for r in messy.select("doc_id", "text").collect()]
    assert run_kept(messy, length=50) == plain_kept(source, 50)
    assert run_kept(messy, length=20, k=8, group_bytes=5000, bucket_bytes=3000, batch=3) == plain_kept(source, 20)


def test_kept_bytes_of_related_texts(spark):
    """Copies with changes, shared passages at all offsets, runs of one letter, and bytes of several lengths."""
    draw = random.Random(11)
    passages = ["".join(draw.choice("abcd é世") for _ in range(draw.randint(30, 300))) for _ in range(12)]
    rows = []
    for i in range(80):
        text = "".join(
            draw.choice(passages)[draw.randint(0, 40) :] if draw.random() < 0.5 else "".join(draw.choice("xyz") for _ in range(draw.randint(0, 60)))
            for _ in range(draw.randint(0, 6))
        )
        rows.append((draw.randint(0, 60), text + "m" * draw.choice([0, 0, 49, 50, 51, 130])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for options in ({"length": 50}, {"length": 50, "group_bytes": 900, "bucket_bytes": 500, "batch": 2}, {"length": 12, "k": 5, "group_bytes": 2000}):
        assert run_kept(docs, **options) == plain_kept(rows, options["length"])


def test_kept_bytes_of_a_text_longer_than_a_block(spark):
    draw = random.Random(5)
    base = "".join(draw.choice("abcdefgh ") for _ in range(suffix_dedup.BLOCK + 5000))
    rows = [(2, base), (1, base[100_000:140_000] + "Q" + base[3000:3300])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r[0]: r for r in run_kept(docs)}
    last = base[140_000 - 1 : 140_000]
    assert len(base) < 140_000 and last == ""
    assert found[1][2] == 0 and found[2][2] == len(base) - 100_000 + 300


def test_a_frequent_anchor_is_divided(spark):
    """One stem in all documents, with different neighbours: no collection may hold all its segments."""
    import pyarrow as pa

    draw = random.Random(5)
    stem, tails = "https://www.example.com/articles/2021/no", ["".join(draw.choice("abcdefgh/") for _ in range(60)) for _ in range(300)]
    rows = [(i, draw.choice(tails)[:48] + stem + draw.choice(tails)[draw.randint(0, 20) :]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    frequent = suffix_dedup.frequent_anchors(docs, 50, 16, 40)
    assert len(frequent)
    table = pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows])})

    def largest(group):
        return np.unique(group.hashes, return_counts=True)[1].max()

    assert largest(suffix_dedup.Group(table, 50, 16)) > 40 >= largest(suffix_dedup.Group(table, 50, 16, frequent))
    for options in ({"most": 40}, {"most": 2, "group_bytes": 3000, "bucket_bytes": 900, "batch": 2}, {"most": 40, "group_bytes": 2000}):
        assert run_kept(docs, **options) == plain_kept(rows, 50)


def test_column_wise_order():
    draw = random.Random(1)
    texts = [bytes(draw.choice(b"ab\0") for _ in range(draw.randint(0, 25))) for _ in range(120)]
    sizes = np.array([len(t) for t in texts])
    owner, size, common = suffix_dedup.column_wise(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)
    suffixes = [texts[o][len(texts[o]) - s :] for o, s in zip(owner.tolist(), size.tolist(), strict=True)]
    assert len(suffixes) == sizes.sum() + len(texts) and suffixes == sorted(suffixes)
    for i in range(1, len(suffixes)):
        a, b = suffixes[i - 1], suffixes[i]
        n = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common[i] == n


@pytest.mark.parametrize(("length", "k"), [(50, 16), (20, 8), (12, 5), (9, 8)])
def test_only_segments_that_share_no_string_stay_out_of_the_order(length, k):
    import pyarrow as pa

    draw = random.Random(length)
    parts = ["".join(draw.choice("abcd ") for _ in range(draw.randint(5, 90))) for _ in range(40)]
    texts = ["".join(draw.choice(parts)[draw.randint(0, 4) :] for _ in range(12)) for _ in range(150)]
    group = suffix_dedup.Group(pa.table({"doc_id": pa.array(range(150), pa.int64()), "text": pa.array(texts)}), length, k)
    data = group.data.tobytes()
    segments = [data[a : a + n + length - 1] for a, n in zip(group.first[group.sample].tolist(), group.count[group.sample].tolist(), strict=True)]
    anchor = np.unique(group.hashes, return_inverse=True)[1]
    kept = suffix_dedup.may_share(segments, anchor, length, k)
    holders = {}
    for n, (segment, a) in enumerate(zip(segments, anchor.tolist(), strict=True)):
        for i in range(len(segment) - length + 1):
            holders.setdefault((a, segment[i : i + length]), set()).add(n)
    shared = {n for some in holders.values() if len(some) > 1 for n in some}
    found = set(np.flatnonzero(kept).tolist())
    assert shared and shared <= found
    assert len(found) < len(segments) or length < 12
    assert not suffix_dedup.may_share([], anchor[:0], length, k).any()


def test_kept_bytes_of_an_empty_table(nothing):
    assert run_kept(nothing) == []


def test_a_group_does_not_depend_on_the_order_of_its_rows():
    import pyarrow as pa

    draw = random.Random(9)
    rows = [(i // 2, "".join(draw.choice("abcdef gh") for _ in range(draw.randint(0, 9000)))) for i in range(60)] + [(None, "x" * 700)] * 2
    tables = []
    for _ in range(3):
        draw.shuffle(rows)
        tables.append(suffix_dedup.Group(pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows])}), 50, 16))
    for name in ("hashes", "digest", "least"):
        a, b, c = (getattr(t, name) for t in tables)
        assert np.array_equal(a, b) and np.array_equal(b, c)
