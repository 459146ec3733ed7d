"""Window frames over the days of one flock, and columns from SQL expressions.

Every frame uses the same partition and order, so Spark plans one exchange and one
sort for all of them. A flock has at most a few dozen days: partitions stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from broodspark.schema import FLOCK


def _over(keys: list[str], day: str, rows: str = "") -> str:
    return f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {day} {rows})"


def by_day(keys: list[str] = FLOCK, day: str = "day") -> str:
    """For ``lag``, ``lead`` and ``row_number``."""
    return _over(keys, day)


def so_far(keys: list[str] = FLOCK, day: str = "day") -> str:
    return _over(keys, day, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")


def whole_flock(keys: list[str] = FLOCK, day: str = "day") -> str:
    return _over(keys, day, "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")


def last_days(days: int, skip: int = 0, keys: list[str] = FLOCK, day: str = "day") -> str:
    """The ``days`` days that end ``skip`` days before the current one."""
    end = f"{skip} PRECEDING" if skip else "CURRENT ROW"
    return _over(keys, day, f"ROWS BETWEEN {days + skip - 1} PRECEDING AND {end}")


def named(columns: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in columns.items()]


def derive(df: DataFrame, **columns: str) -> DataFrame:
    """Add new columns; each is an SQL expression over the columns of ``df``."""
    return df.selectExpr("*", *named(columns))


def rederive(df: DataFrame, **columns: str) -> DataFrame:
    """Like ``derive``, but columns of the same name are replaced."""
    present = set(df.columns)
    replaced = [c for c in columns if c in present]
    star = f"* EXCEPT ({', '.join(replaced)})" if replaced else "*"
    return df.selectExpr(star, *named(columns))
