"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broodspark.session import shared_dir


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder; lineage ends here.

    The folder is the one that the session names in ``spark.checkpoint.dir``; a local session
    without that setting gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), whatever other columns there are; a missing text counts as empty."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))


def fold(id_col: str, folds: int) -> Column:
    """The fold of a document: CRC-32 of its id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
