"""Personal data: base patterns, and bootstrapped contextual extraction, with DataFrame functions only.

Seeds are the tokens that a base pattern covers, with or without a digit. The lexical pattern of a token is the two words before
it, or the one before it if that ends like a label (``contact:``, ``id=``). Patterns and token values form a bipartite
graph; a pattern scores by the share of its distinct values, plain words among them, that are personal. All tokens after patterns of
high confidence that no base pattern knows are reported as further spans, and count as seeds of the next round, wherever they are.

One pass over the texts writes spans, seeds, and the edges of all tokens that are no plain words, as pairs of hashes; the rounds run on that
table. Another pass, in parts, counts the plain words after the patterns that may be good, and if any is good a last one finds the
places. Patterns go to these passes as sets of a bounded size, one pass per block of them, so the texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broodspark.llm.common import checkpointed

#: The base patterns, in the order in which ties are listed. They match what the plain
#: patterns match, but start only at the start of a run and never give a character back, so that long runs of
#: letters or digits are read once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "context")
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: The value in a token: from its first letter or digit to its last.
CORE = r"(?s)[\p{L}\p{N}](?:.*[\p{L}\p{N}])?"
#: A token whose value is not a plain word: it has a digit, or letters on both sides of something else.
OTHER = r"\p{N}|\p{L}[^\p{L}\p{N}]+\p{L}"
LABEL = (":", "=")
WHITE = " \t\n\x0b\f\r"
PAIRS = "array<struct<pattern:string,value:string>>"
EDGES = "array<struct<p:bigint,v:bigint>>"
BLOCK = 10_000  # patterns that one pass over the texts looks for
PARTS = ((0, 1), (1, 8), (8, 64))  # sixty-fourths of the texts in which patterns are tried


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(value: Column) -> Column:
    part = F.split(value, r"\.")
    small = F.transform(part, lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(small, lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255")))


def _is_card(value: Column) -> Column:
    digits = _digits(value)
    size = F.length(digits)

    def worth(i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((size - i) % 2 == 1, digit * 2).otherwise(digit)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda s, i: s + worth(i))
    return size.between(14, 19) & (total % 10 == 0)


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


def _places(text: Column, pattern: str, may: Column) -> Column:
    """Matches of a pattern as structs (start, value, left): where it starts, the match, and the text since the one before.

    The pieces between the matches give the places: their lengths and those of the matches add up.
    """
    found = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,value:string,left:string>>")
    one = F.named_struct

    def step(so_far: Column, both: Column) -> Column:
        start = so_far["at"] + F.char_length(both["left"])
        item = one(F.lit("start"), start, F.lit("value"), both["value"], F.lit("left"), both["left"])
        return one(
            F.lit("at"), start + F.char_length(both["value"]),
            F.lit("out"), F.concat(so_far["out"], F.array(item).cast("array<struct<start:int,value:string,left:string>>")),
        )

    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, v: one(F.lit("left"), p, F.lit("value"), v))
    placed = F.aggregate(pairs, one(F.lit("at"), F.lit(0), F.lit("out"), empty), step, lambda s: s["out"])
    return F.when(F.size(found) > 0, placed).otherwise(empty)


def _spans(places: Column, kind: int, valid) -> Column:
    kept = F.filter(places, lambda x: valid(x["value"])) if valid else places
    return F.transform(
        kept,
        lambda x: F.named_struct(
            F.lit("start"), x["start"], F.lit("kind"), F.lit(kind), F.lit("end"), x["start"] + F.char_length(x["value"])
        ),
    ).cast(SPAN)


def _number(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))


def _pattern(second: Column, first: Column) -> Column:
    """The pattern that two words make, the nearer one last; without one before it, a word follows the start of the text."""
    label = F.lit(False)
    for end in LABEL:
        label = label | first.endswith(end)
    return F.when(label, first).otherwise(F.concat(F.coalesce(second, F.lit("^")), F.lit(" "), first))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last_word(text: Column) -> Column:
    return F.substring_index(text, " ", -1)


def _without_last(text: Column) -> Column:
    return F.rtrim(F.substring(text, F.lit(1), F.char_length(text) - F.char_length(_last_word(text))))


def _seeds(flat: Column, span: Column) -> Column:
    """(pattern, value) of each token that a span touches; ``flat`` is the text with blanks as its only white space."""
    left = F.substring(flat, F.lit(1), span["start"])
    inside = F.substring(flat, span["start"] + 1, span["end"] - span["start"])
    tail = F.substring_index(F.substring(flat, span["end"] + 1, F.char_length(flat)), " ", 1)

    def pairs(before: Column) -> Column:
        first, second = _last_word(before), _last_word(_without_last(before))
        line = F.lower(F.concat(second, F.lit("  "), first, F.lit("  "), _last_word(left), inside, tail))
        return _bound(F.split(line, "  | +"), lambda w: F.transform(
            F.sequence(F.lit(2), F.size(w) - 1),
            lambda i: F.named_struct(
                F.lit("pattern"), F.when(F.get(w, i - 1) != "", _pattern(F.nullif(F.get(w, i - 2), F.lit("")), F.get(w, i - 1))),
                F.lit("value"), F.regexp_extract(F.get(w, i), CORE, 0),
            ),
        ))

    return _bound(_without_last(left), pairs).cast(PAIRS)


def _words(flat: Column) -> Column:
    return F.split(F.lower(F.trim(flat)), " +")


def _edge(words: Column, i: Column) -> Column:
    return F.named_struct(
        F.lit("p"), F.xxhash64(_pattern(F.get(words, i - 2), F.get(words, i - 1))),
        F.lit("v"), F.xxhash64(F.regexp_extract(F.get(words, i), CORE, 0)),
    )


def _edges(words: Column) -> Column:
    """Hashes of (pattern, value) of all tokens that are no plain words."""
    return _bound(words, lambda w: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i > 0) & F.get(w, i).rlike(OTHER)), lambda i: _edge(w, i)
    )).cast(EDGES)


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key of the text, base spans, seeds: (pattern, value) of every token that a base span touches, and edges."""
    text = F.col("text")
    digit = text.rlike("[0-9]")
    at, plus, dot = F.contains(text, F.lit("@")), F.contains(text, F.lit("+")), F.contains(text, F.lit("."))
    spans = {
        "email": _spans(_places(text, EMAIL, at), 0, None),
        "ip": _spans(_places(text, IP, F.col("_digit") & dot), 1, _is_ip),
        "card": _spans(_places(text, CARD, F.col("_digit")), 2, _is_card),
        "phone": _spans(_places(text, PHONE, F.col("_digit") & plus), 3, _is_phone),
    }
    base = _rows(docs, id_col, text_col).withColumn("_digit", digit).select(
        "doc_id", "key", *(s.alias(k) for k, s in spans.items()), _flat("text").alias("flat"),
    ).withColumn("base", F.concat("email", "ip", "card", "phone"))
    seeds = F.array_distinct(F.flatten(F.transform("base", lambda s: _seeds(F.col("flat"), s))))
    return base.select("doc_id", "key", "base", seeds.alias("seeds"), F.array_distinct(_edges(_words(F.col("flat")))).alias("edges"))


def _flat(text: str) -> Column:
    return F.translate(text, WHITE, " " * len(WHITE))


def _blocks(patterns: DataFrame) -> Iterator[list[int]]:
    """The hashes ``p`` in blocks of about BLOCK; each block is one query set over all texts."""
    n = -(-patterns.count() // BLOCK)
    for block in range(n):
        yield [r[0] for r in patterns.filter(F.pmod("p", F.lit(n)) == block).select("p").collect()]


def _tokens_after(block: list[int], words: Column, plain: bool) -> Column:
    """The numbers of the tokens after patterns of a block, either the plain words or the others."""
    def wanted(i: Column) -> Column:
        other = F.get(words, i).rlike(OTHER)
        return (i > 0) & F.xxhash64(_pattern(F.get(words, i - 2), F.get(words, i - 1))).isin(block) & (~other if plain else other)

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), wanted)


def _plain_edges(block: list[int]):
    return lambda w: F.transform(_tokens_after(block, w, plain=True), lambda i: _edge(w, i))


def _plain_words(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(p, v): the distinct plain words after each pattern."""
    parts = []
    for block in _blocks(patterns):
        edges = _bound(_words(_flat("text")), _plain_edges(block))
        parts.append(checkpointed(rows.select(F.inline(F.array_distinct(edges.cast(EDGES)))).distinct()))
    return reduce(DataFrame.union, parts) if parts else patterns.selectExpr("p", "p AS v").filter("false")


def _scored(rows: DataFrame, patterns: DataFrame, confidence: float, prior: float) -> DataFrame:
    """(p, n, other, plain) of the patterns that score ``confidence`` or more, with all plain words after them.

    The texts are read in three parts, by a hash: more texts only add words, so a pattern that falls below the confidence in
    the first texts is done with, and the words after common patterns are not gathered from all of them.
    """
    alive, seen = patterns.select("p", "n", "other"), None
    for first, end in PARTS:
        words = _plain_words(rows.filter(F.pmod("key", F.lit(PARTS[-1][1])).between(first, end - 1)), alive)
        seen = words if seen is None else seen.join(alive.select("p"), "p", "left_semi").union(words).distinct()
        counted = alive.select("p", "n", "other").join(seen.groupBy("p").agg(F.count("*").alias("plain")), "p", "left").fillna(0, "plain")
        alive = checkpointed(counted.filter(F.col("n") / (F.col("other") + F.col("plain") + prior) >= confidence))
    return alive


def good_patterns(
    rows: DataFrame, found: DataFrame, rounds: int, confidence: float, support: int, prior: float = 1.0
) -> DataFrame:
    """(p): hashes of the patterns with ``support`` different personal values after them, which are ``confidence`` of all.

    The share is the number of distinct personal values over the number of distinct values plus ``prior``. After each
    round but the last the values that good patterns found are personal too, if good patterns are at
    least ``1 - confidence`` of all patterns before them: a value that most contexts share says nothing.
    """
    seeds = found.filter(F.size("seeds") > 0).selectExpr("inline(seeds)").filter(F.col("pattern").isNotNull() & F.col("value").rlike(OTHER))
    personal = checkpointed(seeds.select(F.xxhash64("pattern").alias("p"), F.xxhash64("value").alias("v")).distinct())
    edges = checkpointed(found.filter(F.size("edges") > 0).selectExpr("inline(edges)").distinct())
    others = edges.groupBy("p").agg(F.count("*").alias("other"))
    plain = good = None  # the plain words after good patterns are counted once; a pattern that was good stays so
    for turn in range(max(1, rounds)):
        supported = personal.groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
        may = checkpointed(supported.join(others, "p").filter(F.col("n") / (F.col("other") + prior) >= confidence))
        known = may.limit(0).withColumn("plain", F.lit(0).cast("bigint")) if plain is None else may.join(plain, "p")
        new = may.join(known.select("p"), "p", "left_anti")
        good = checkpointed(known.union(_scored(rows, new, confidence, prior)).select("p", "plain"))
        plain = good
        good = good.select("p")
        if turn + 1 >= rounds or good.isEmpty():
            break
        values = checkpointed(edges.join(good, "p", "left_semi").join(personal, ["p", "v"], "left_anti").select("v").distinct())
        if values.isEmpty():
            break
        around = edges.join(values, "v", "left_semi")
        share = around.join(good.withColumn("good", F.lit(1)), "p", "left").groupBy("v").agg((F.count("good") / F.count("*")).alias("share"))
        promoted = around.join(share.filter(F.col("share") >= 1 - confidence).select("v"), "v", "left_semi")
        before, personal = personal.count(), checkpointed(personal.union(promoted.select("p", "v")).distinct())
        if personal.count() == before:
            break
    return good


def _context(rows: DataFrame, good: DataFrame) -> DataFrame | None:
    """(_doc, _key, context): the places of all tokens after the patterns, for documents that have any; None without patterns.

    Pieces are the words with the blanks after them, so their lengths give the places; only hits look back.
    """
    parts = []
    flat = rows.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), _flat("text").alias("flat"))
    for block in _blocks(good):
        lead = F.char_length("flat") - F.char_length(F.ltrim("flat"))
        found = flat.withColumn("_lead", lead).withColumn("context", _bound(F.split(F.ltrim("flat"), "(?<= )(?=[^ ])"), _places_after(block)))
        shifted = F.transform("context", lambda s: F.named_struct(
            F.lit("start"), s["start"] + F.col("_lead"), F.lit("kind"), s["kind"], F.lit("end"), s["end"] + F.col("_lead")
        ))
        parts.append(found.filter(F.size("context") > 0).select("_doc", "_key", shifted.cast(SPAN).alias("context")))
    if not parts:
        return None
    every = reduce(DataFrame.union, parts).dropDuplicates()
    return every.groupBy("_doc", "_key").agg(F.array_distinct(F.flatten(F.collect_list("context"))).alias("context"))


def _places_after(block: list[int]):
    def spans(pieces: Column) -> Column:
        words = F.transform(pieces, lambda p: F.lower(F.rtrim(p)))
        return _bound(words, lambda w: F.transform(_tokens_after(block, w, plain=False), lambda i: _place(pieces, i)))

    return spans


def _place(pieces: Column, i: Column) -> Column:
    """The span of the value in a piece, counted from the first piece."""
    word = F.rtrim(F.get(pieces, i))
    before = F.char_length(F.array_join(F.slice(pieces, F.lit(1), i), ""))
    start = before + F.char_length(word) - F.char_length(F.regexp_replace(word, r"^[^\p{L}\p{N}]++", ""))
    return F.named_struct(F.lit("start"), start, F.lit("kind"), F.lit(4), F.lit("end"), start + F.char_length(F.regexp_extract(word, CORE, 0)))


def with_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, confidence: float = 0.75, support: int = 3
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans for every row.

    ``context`` spans are tokens, other than plain words (letters only), after a pattern that has at least ``support`` different personal values and at least
    ``confidence`` as its score. Spans are kind:start:end in code points, end exclusive, by start
    and then by kind. A missing or empty text has none. Repeated rows stay, each with the same
    result; rows without an id are kept. An empty table gives no rows.
    """
    source = _rows(docs, id_col, text_col)
    found = checkpointed(read(docs, id_col, text_col))
    more = _context(source, good_patterns(source, found, rounds, confidence, support))
    base = found.select("doc_id", "key", "base")
    if more is None:
        rows = base.withColumn("context", F.array().cast(SPAN))
    else:
        rows = base.join(more, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left")
    context = F.filter(
        F.coalesce("context", F.array().cast(SPAN)),
        lambda c: ~F.exists("base", lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"])),
    )
    return rows.select(
        "doc_id", *(_number(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS[:4])), F.size(context).cast("bigint").alias("n_context"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", context)).alias("spans"),
    )
