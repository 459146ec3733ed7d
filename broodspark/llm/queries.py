"""One query per operator, over the whole table it is meant for, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broodspark.llm import (
    byte_bpe,
    conversations,
    decontaminate,
    exact_dedup,
    language,
    packing,
    periodic,
    pii,
    quality,
    secrets,
    simhash,
    suffix_dedup,
    toxicity,
)
from broodspark.llm.common import documents, fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def token_files() -> tuple[str, str]:
    """The installed vocabulary, as ranks and as the file of the other library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark_copies(documents(spark, sf_dir).select("doc_id", "text"), keep="largest")
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op1_exact_dedup"] = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), *token_files())


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = decontaminate.with_contamination(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    found = F.col("contamination")
    return marked.select(
        "doc_id", found["n_words"].alias("n_words"), found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        found["contaminated"].alias("contaminated"),
    )


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity.with_score(docs, _labels(spark, sf_dir), folds=3, held_out=1)
    return scored.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.scored(documents(spark, sf_dir), _labels(spark, sf_dir), folds=4, held_out=2)
    return scored.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.with_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "secrets.*")


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language.with_language(documents(spark, sf_dir).select("doc_id", "text", "lang"), folds=4, held_out=2)
    return docs.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("language")["lang"].alias("lang_pred"),
        F.col("language")["score"].alias("score"),
    )


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_personal_data(documents(spark, sf_dir))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.with_kept_bytes(documents(spark, sf_dir), length=50)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_files()[1]
    docs = byte_bpe.with_ids(documents(spark, sf_dir).select("doc_id", "text"), vocabulary).drop("text")
    return byte_bpe.with_decoded(docs, vocabulary).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_repeated_tails(documents(spark, sf_dir).select("doc_id", "text"))
    runs = F.col("periodic")["runs"]
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (
        periodic.with_runs(docs)
        .withColumn("most", periodic.longest(runs))
        .select(
            "doc_id", F.size(runs).cast("bigint").alias("n_runs"), "most.start", "most.length", "most.period",
            F.floor(F.col("most")["length"] * 1000 / F.col("most")["period"]).cast("bigint").alias("exponent_milli"),
            F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("periodic")["collapsed"], 256).alias("collapsed_sha256"),
        )
    )


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    repaired = conversations.repaired(conversations.with_damage(talks))
    return conversations.with_all(repaired, talks)
