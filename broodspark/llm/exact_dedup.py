"""Exact duplicates by a content sort, with DataFrame functions only.

Sampled splitters deal the rows out by ranges of their leading bytes and a 64-bit hash, an
external sort places equal texts side by side, and the window compares neighbours in full:
its groups are runs of equal whole texts. The splitters hold 32 bytes and a hash, not the
text, so what the driver samples is bounded by the number of partitions alone.

A text with very many copies would be one range. Texts with more copies than ``hot_rows``
(or than a 100,000th of all rows, if that is more) are counted first by their hash; there are at most
100,000 of them, so their list may be broadcast. Their copies are sorted in slices of about
that many rows, and the slices are merged by pre-aggregated sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broodspark.llm.common import checkpointed, fresh

HOT_TEXTS = 100_000
PREFIX_BYTES = 32


def _unchanged(text: Column) -> Column:
    return text


def mark_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = _unchanged,
    keep: str = "smallest",
    hot_rows: int = 256,
) -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` added.

    Rows are equal when their normalised texts are identical byte by byte; a missing text
    counts as empty. The row with the smallest (or largest) id stays. Missing ids are never
    chosen while another id is there; ``keep_id`` is then NULL only for groups without any
    id. Of rows that repeat text and id one is kept. Columns of the input that have the
    names of the result are replaced; an empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    best = F.max if keep == "largest" else F.min
    results = ("keep_id", "group_size", "kept", "text_sha256")
    docs = docs.drop(*(c for c in results if c not in (id_col, text_col)))
    content, lead, key, slices, part, rank, hot_key, hot_digest, hot_best, hot_size = (
        fresh(docs, f"_{n}")
        for n in ("content", "lead", "key", "slices", "slice", "rank", "hot_key", "hot_digest", "hot_best", "hot_size")
    )
    rows = (
        docs.withColumn(content, normalise(F.coalesce(F.col(text_col), F.lit(""))))
        .withColumn(lead, F.substring(F.col(content).cast("binary"), 1, PREFIX_BYTES))
        .withColumn(key, F.xxhash64(content))
    )
    limit = max(hot_rows, docs.count() // HOT_TEXTS)
    hot = checkpointed(
        rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
        .select(key, F.ceil(F.col("_n") / limit).alias(slices))
    )
    rows = rows.join(F.broadcast(hot), key, "left")
    digest = F.sha2(F.col(content), 256)
    merged = (
        rows.filter(F.col(slices).isNotNull()).groupBy(key, content)
        .agg(best(id_col).alias(hot_best), F.count("*").alias(hot_size))
        .select(F.col(key).alias(hot_key), digest.alias(hot_digest), hot_best, hot_size)
    )
    dealt = rows.withColumn(part, F.when(F.col(slices).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(id_col), slices)))
    order = F.col(id_col).desc_nulls_last() if keep == "largest" else F.col(id_col).asc_nulls_last()
    run = Window.partitionBy(lead, key, part, content).orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (
        dealt.repartitionByRange(lead, key, part)
        .withColumns({
            "keep_id": best(id_col).over(whole),
            "group_size": F.count("*").over(whole),
            rank: F.row_number().over(run),
        })
        .withColumn("text_sha256", digest)
        .drop(content, lead, part)
    )
    found = runs.join(
        F.broadcast(merged),
        F.col(slices).isNotNull() & (F.col(key) == F.col(hot_key)) & (F.col("text_sha256") == F.col(hot_digest)),
        "left",
    )
    split = F.col(hot_key).isNotNull()
    return (
        found.withColumn("keep_id", F.when(split, F.col(hot_best)).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.when(split, F.col(hot_size)).otherwise(F.col("group_size")))
        .withColumn("kept", (F.col(rank) == 1) & F.col(id_col).eqNullSafe(F.col("keep_id")))
        .drop(key, slices, rank, hot_key, hot_digest, hot_best, hot_size)
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The kept rows, with the columns of the input."""
    return mark_copies(docs, **options).filter("kept").select(*docs.columns)
