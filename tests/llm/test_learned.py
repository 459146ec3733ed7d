"""Toxicity, quality and language: held-out accuracy, the method's own promise, and odd tables."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from broodspark.llm import language, quality, toxicity
from broodspark.llm.linear import letter_words

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd_labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (4, 1, 0), (None, 1, 1), (9, 0, None), (77, None, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def remainder(doc, folds):
    return zlib.crc32(str(doc).encode()) % folds


def test_toxicity_on_held_out_documents(docs, labels):
    scored = toxicity.with_score(docs, labels).join(labels, "doc_id").select("doc_id", "score", "toxic").toPandas()
    held = scored[scored.doc_id.map(lambda d: remainder(d, 3) == 1)]
    assert scored.score.between(0, 1).all()
    assert ((held.score >= 0.7) == (held.toxic == 1)).mean() > 0.9


def test_labels_of_the_held_out_fold_are_not_learned_from(docs, labels):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert np.array_equal(a["weights"], b["weights"]) and a["bad"] == b["bad"]


def test_identity_terms_do_not_move_the_score(spark):
    """In the labels, insults come with one group; the penalty takes the group's own weight away."""
    rows, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        group = "muslim" if toxic or i % 16 == 1 else "christian" if i % 3 == 0 else "weather"
        rows.append((i, f"talk about a {group} today number{i % 7} " + ("vermin scum" if toxic and i % 8 == 0 else "filth" if toxic else "")))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    probe = spark.createDataFrame([(1, "a muslim came"), (2, "a christian came"), (3, "a buddhist came"), (4, "scum vermin")], "doc_id bigint, text string")

    def scores(weight):
        column = toxicity.score_column(toxicity.fit(docs, labels, held_out=None, swap_weight=weight))
        return [r.s for r in probe.select("doc_id", column("text").alias("s")).orderBy("doc_id").collect()]

    free, held = scores(0.0), scores(10.0)
    assert abs(free[0] - free[1]) > 0.1 > 20 * abs(held[0] - held[1])
    assert max(held[:3]) < 0.5 < held[3]


def test_toxicity_of_a_messy_table(messy, odd_labels, nothing):
    scored = toxicity.with_score(messy, odd_labels, held_out=None, into="p")
    assert scored.columns == [*messy.columns, "p"] and scored.count() == messy.count()
    rows = scored.select("doc_id", "text", "p").collect()
    assert all(0 <= r.p <= 1 for r in rows)
    assert len({r.p for r in rows if not r.text}) == 1
    assert toxicity.drop_toxic(messy, odd_labels).columns == messy.columns
    assert toxicity.with_score(nothing, odd_labels).count() == 0
    assert toxicity.with_score(messy, odd_labels.filter("false"), into="p").filter("p > 0.01").count() == 0


def test_quality_on_held_out_documents(docs, labels):
    scored = quality.scored(docs, labels).join(labels.filter("quality IS NOT NULL"), "doc_id").toPandas()
    held = scored[scored.doc_id.map(lambda d: remainder(d, 4) == 2)]
    assert scored.score.between(0, 1).all() and (scored.good == (scored.score >= 0.7)).all()
    assert ((held.score >= 0.7) == (held.quality == 1)).mean() > 0.9


def test_the_cut_is_a_quantile_of_all_documents(docs, labels):
    """The level decides, not a value of the score: without most of the bad documents the same share is cut off."""
    model = quality.fit(docs, labels)
    rows = quality.scored(docs, labels).collect()
    raw = sorted(r.raw for r in rows)
    below = sum(not r.good for r in rows)
    cut = min(r.raw for r in rows if r.good)
    assert abs(below / len(rows) - model["bad"]) <= 2 / len(rows) or raw.count(cut) > 1
    assert all(r.good == (r.raw >= cut) == (r.score >= 0.7) for r in rows)
    shifted = docs.join(labels.filter("quality = 0 AND doc_id % 5 > 0"), "doc_id", "left_anti")
    other = quality.scored(shifted, labels).collect()
    share = quality.fit(shifted, labels)["bad"]
    higher = min(r.raw for r in quality.scored(docs, labels, level=0.5).collect() if r.good)
    assert higher > cut and share < model["bad"]
    assert abs(sum(not r.good for r in other) / len(other) - share) <= 0.02
    half = quality.scored(docs, labels, level=0.5).collect()
    assert abs(sum(not r.good for r in half) / len(half) - 0.5) <= 0.02
    assert all(r.good for r in quality.scored(docs, labels, level=0.0).collect())


def test_parting_point():
    assert 2 < quality.parting(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0, 0, 1, 1])) < 3
    assert quality.parting(np.array([5.0, 1.0, 3.0]), np.array([1, 1, 1])) < 1
    assert 3 < quality.parting(np.array([1.0, 2.0, 3.0, 4.0, 5.0]), np.array([0, 1, 0, 1, 1])) < 4


def test_quality_of_a_messy_table(messy, odd_labels, nothing):
    rows = quality.scored(messy, odd_labels, held_out=None).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert {r.score for r in quality.scored(messy, odd_labels.filter("false")).collect()} == {0.5}
    assert quality.scored(nothing, odd_labels).count() == 0


def test_language_on_held_out_documents(docs):
    found = language.with_language(docs).select("doc_id", "lang", "language.lang", "language.score").toDF("doc_id", "lang", "found", "score").toPandas()
    held = found[found.doc_id.map(lambda d: remainder(d, 4) == 2)]
    assert (held.lang == held.found).mean() > 0.97 and held.score.between(0, 1).all()


def test_word_counts_cover_all_rows(docs):
    words = {}
    for r in docs.select("lang", "text").collect():
        for w in letter_words(r.text or ""):
            words[r.lang, w.decode()] = words.get((r.lang, w.decode()), 0) + 1
    counts = language.word_counts(docs, hold=500).collect()
    assert {(r.lang, r.word): r.n for r in counts} == words


def test_the_number_of_known_words_never_falls(spark):
    """Words of one count fill the table up to its bound, in the order of their hashes."""
    rows = [("en", f"w{chr(97 + i % 26)}{chr(97 + i // 26)}", 1) for i in range(120)] + [("en", "often", 9), ("de", "wort", 1), ("de", "auch", 2)]
    counts = spark.createDataFrame(rows, "lang string, word string, n bigint")
    before = set()
    for known in (1, 2, 60, 119, 120, 121, 130):
        kept = language._most_frequent(counts, ["lang"], "word", known)
        words = {r.word for r in kept.filter("lang = 'en'").collect()}
        assert len(words) == min(known, 121) and before <= words and "often" in words
        assert kept.filter("lang = 'de'").count() == min(known, 2)
        before = words


def test_language_with_the_bound_in_force(docs):
    """A table of 150 words per language is far below the vocabulary; rare words back off."""
    found = language.with_language(docs, known=150).select("doc_id", "lang", "language.lang").toDF("doc_id", "lang", "found").toPandas()
    held = found[found.doc_id.map(lambda d: remainder(d, 4) == 2)]
    assert (held.lang == held.found).mean() > 0.95


def test_unseen_words_back_off(spark):
    docs = spark.createDataFrame(
        [(1, "the thing then this that", "en"), (2, "schnell schule schön schaf", "de")] * 3, "doc_id bigint, text string, lang string"
    )
    column = language.predict_column(language.fit(docs, known=10))
    probe = spark.createDataFrame([("thistle",), ("schiff",), ("zzz 的",), ("12 !",), (None,)], "text string")
    found = [r.p for r in probe.select(column("text").alias("p")).collect()]
    assert [f.lang for f in found] [:2] == ["en", "de"] and found[2].lang in ("de", "en")
    assert [(f.lang, f.score) for f in found[3:]] == [("und", 0.0)] * 2


def test_language_of_a_messy_table(messy, nothing):
    found = language.with_language(messy, folds=None, into="p")
    assert found.columns == [*messy.columns, "p"] and found.count() == messy.count()
    for r in found.select("text", "p").collect():
        assert (r.p.lang == "und") == (not r.text or not any(map(str.isalpha, r.text))), r.text
    assert language.with_language(nothing).count() == 0
    unlearned = language.with_language(messy.withColumn("lang", F.lit(None).cast("string")), into="p")
    assert {r.p.lang for r in unlearned.select("p").collect()} == {"und"}


def plain_words(text):
    """Letters of words: a to z, and all that is not ASCII."""
    return "".join(c if "a" <= c <= "z" or c > "\x7f" else " " for c in (text or "").lower()).split(" ")


def test_toxicity_scores_equal_a_plain_version(docs, labels, messy):
    model = toxicity.fit(docs, labels)

    def plain(text):
        counts = Counter()
        for word in filter(None, plain_words(text)):
            data = word.encode()
            sizes = [n for n in (4, 5) if len(data) > n]
            counts.update([xxhash.xxh32(data).intdigest(), *(xxhash.xxh32(data[:n], seed=n).intdigest() for n in sizes)])
        total = model["base"] + sum(math.log(1 + n) * model["weights"].get(k, 0.0) for k, n in counts.items())
        return 1 / (1 + math.exp(-total))

    for table in (docs, messy):
        rows = toxicity.with_score(docs, labels).collect() if table is docs else messy.select("text", toxicity.score_column(model)("text").alias("score")).collect()
        assert len(rows) == table.count()
        assert max(abs(r.score - plain(r.text)) for r in rows) < 1e-9


def test_quality_scores_equal_a_plain_version(docs, labels):
    model = quality.fit(docs, labels)
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text or "")

    def plain(text):
        x = quality.measures(text)
        wide = [*x, *(max(0.0, a - k) for knots in model["knots"].tolist() for a, k in zip(x, knots, strict=True))]
        return sum((v - c) / s * w for v, c, s, w in zip(wide, model["centre"], model["spread"], model["weights"], strict=True))

    rows = quality.scored(docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter({d: len(t) for d, t in texts.items()})
    assert all(min(abs(r.raw - plain(t)) for t in texts[r.doc_id]) < 1e-6 for r in rows)
    raw = sorted(r.raw for r in rows)
    cut = raw[max(0, math.ceil(model["bad"] * len(raw)) - 1)]  # the least score that so many do not exceed
    for r in rows:
        curve = 1 / (1 + math.exp(-(r.raw - cut + math.log(0.7 / 0.3))))
        assert abs(r.score - curve) < 1e-9 and r.good == (r.raw >= cut) == (r.score >= 0.7)
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    bad = {r.doc_id for r in labels.collect() if r.quality == 0}
    ranks = {r.doc_id: r.raw for r in rows}
    pairs = [(ranks[a], ranks[b]) for a in good for b in bad if a in ranks and b in ranks]
    assert sum(a > b for a, b in pairs) > 0.98 * len(pairs)


def test_languages_equal_a_plain_version(docs):
    learned = [r for r in docs.select("doc_id", "text", "lang").collect() if r.lang is not None and remainder(r.doc_id, 4) != 2]
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for r in learned:
        words[r.lang].update(filter(None, plain_words(r.text)))
    names = sorted(lang for lang in words if words[lang])
    for lang in names:
        for word, n in words[lang].items():
            for size in (1, 2, 3, 4):
                marked = f"<{word}>"
                for i in range(len(marked) - size + 1):
                    grams[lang, size][marked[i : i + size]] += math.sqrt(n)
    for counts in grams.values():
        counts.update({g: math.ceil(round(n, 9)) - n for g, n in counts.items()})
    word_totals = [words[x].total() for x in names]
    gram_totals = {n: [round(grams[x, n].total()) for x in names] for n in (1, 2, 3, 4)}
    known = set().union(*words.values())
    known_grams = {n: set().union(*(grams[x, n] for x in names)) for n in (1, 2, 3, 4)}

    def row(word):
        if word in known:
            return [math.log((words[x][word] + 0.1) / t) for x, t in zip(names, word_totals, strict=True)]
        marked = f"<{word}>"
        for size in (4, 3, 2, 1):
            each = [marked[i : i + size] for i in range(len(marked) - size + 1)]
            found = [g for g in each if g in known_grams[size]]
            if found and 2 * len(found) >= len(each):
                logs = [[math.log((grams[x, size][g] + 0.1) / t) for x, t in zip(names, gram_totals[size], strict=True)] for g in found]
                return [sum(column) / len(found) for column in zip(*logs, strict=True)]
        return [0.0] * len(names)

    remembered = {}
    rows = language.with_language(docs, known=10_000_000).select("text", "language.lang", "language.score").collect()
    assert len(rows) == docs.count()
    unseen = 0
    for r in rows:
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang, r.score) == ("und", 0.0)
            continue
        total = [0.0] * len(names)
        for word in filter(None, plain_words(r.text)):
            unseen += word not in known
            if word not in remembered:
                remembered[word] = row(word)
            total = [a + b for a, b in zip(total, remembered[word], strict=True)]
        best = max(total)
        share = 1 / sum(math.exp(t - best) for t in total)
        assert abs(r.score - share) < 1e-2
        assert r.lang == names[total.index(best)] or share < 0.6
    assert unseen > 0
