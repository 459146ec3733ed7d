"""Small tables: literal rows, and the size check before a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast side may hold this many rows and no more.
SMALL_ROWS = 50_000
# Rows beyond this number are handed over as data, not as text of the query.
VALUES_ROWS = 1_000


def _cell(value, kind: str) -> str:
    quoted = "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else value
    return f"CAST({'NULL' if value is None else quoted} AS {kind})"


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows that the driver holds as a table, any number of them."""
    fields = [part.strip().rsplit(" ", 1) for part in schema.split(",")]
    if not rows or len(rows) > VALUES_ROWS:
        def cell(value, kind: str):
            return None if value is None else float(value) if kind == "double" else value

        return spark.createDataFrame([tuple(cell(row[name], kind) for name, kind in fields) for row in rows], schema)
    values = ", ".join(
        "(" + ", ".join(_cell(row[name], kind) for name, kind in fields) + ")" for row in rows
    )
    names = ", ".join(name for name, _ in fields)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def is_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> bool:
    """Whether the frame has at most ``max_rows`` rows; counting stops there.

    Where the plan itself bounds the rows (literal rows, a range of days), nothing is run.
    """
    bound = df._jdf.queryExecution().optimizedPlan().maxRows()
    if bound.isDefined() and bound.get() <= max_rows:
        return True
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger table keeps the shuffle join."""
    return F.broadcast(df) if is_small(df, max_rows) else df
