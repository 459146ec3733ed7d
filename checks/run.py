"""Run queries and their SQL side by side: python -m checks.run [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from broodspark.session import local_session
from checks.pairs import QUERIES, SQL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN",
}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        file = Path(sf_dir) / f"{name}.parquet"
        if file.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows sorted, missing values alike."""
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    text = df.map(lambda v: "NULL" if v is None else repr(float(v)) if not isinstance(v, str) else v)
    return text.sort_values(list(text.columns)).reset_index(drop=True) if len(text.columns) else text


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> str:
    """'' when rows, columns and values agree, else what differs."""
    frame = QUERIES[name](spark, sf_dir)
    ours = frame.toPandas()
    if name not in SQL:
        return "" if len(ours) else "no rows"
    theirs = con.execute(SQL[name]).df()
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    other = {c: (t, kinds[c]) for c, t in frame.dtypes if c in kinds and TYPES.get(t) != kinds[c]}
    if other:
        return f"types {other}"
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(set(ours.columns) ^ set(theirs.columns))}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows, SQL has {len(theirs)}"
    left, right = canonical(ours), canonical(theirs)
    if left.equals(right):
        return ""
    bad = [c for c in left.columns if not left[c].equals(right[c])]
    where = (left != right).any(axis=1)
    return f"values differ in {bad}:\n{left[where].head(3)}\n{right[where].head(3)}"


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark, con = local_session(8), database(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{'ok  ' if not problem else 'FAIL'} {time.time() - start:6.2f}s {name} {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
