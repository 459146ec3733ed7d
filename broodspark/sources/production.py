"""Reading production inputs: healthy production and the finished production table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broodspark.functions.small import broadcast_if_small
from broodspark.operators.production import RESPONSES, long
from broodspark.schema import require_columns

HEALTHY_SCHEMA = "day int, healthy_DG double, healthy_intake double"
WIDE_COLUMNS = [
    "DG_healthy", "FI_healthy", *RESPONSES,
    *[f"{c}_{f}" for f in ("low", "high") for c in RESPONSES],
]


def read_healthy_production(spark: SparkSession, path: str) -> DataFrame:
    """Daily gain and intake of healthy birds, from CSV or Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        found = spark.read.parquet(path)
    else:
        found = spark.read.csv(path, header=True, nullValue="NA")
    names = [part.split()[0] for part in HEALTHY_SCHEMA.split(", ")]
    kinds = dict(part.split() for part in HEALTHY_SCHEMA.split(", "))
    return require_columns(found, names).select(*[F.col(n).cast(kinds[n]) for n in names])


def read_production(spark: SparkSession, path: str) -> DataFrame:
    """The wide production CSV (one row per day) as the long table."""
    found = require_columns(
        spark.read.csv(path, header=True, nullValue="NA"), ["day", *WIDE_COLUMNS]
    )
    typed = found.select(F.col("day").cast("int"), *[F.col(c).cast("double") for c in WIDE_COLUMNS])
    return broadcast_if_small(long(typed))
