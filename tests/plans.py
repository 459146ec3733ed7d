"""Physical plans as text."""

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_of(df: DataFrame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def operators(df: DataFrame) -> list[str]:
    """Operator names of the plan tree, top first (the part before the details)."""
    tree = plan_of(df).split("\n\n")[0]
    return re.findall(r"[*: +\-]*([A-Z]\w+)", "\n".join(tree.splitlines()[1:]))


def count(df: DataFrame, name: str) -> int:
    return sum(op == name for op in operators(df))


def exchanges(df: DataFrame) -> list[str]:
    """Arguments of the hash exchanges."""
    return re.findall(r"Arguments: hashpartitioning\((.*?), \d+\)", plan_of(df))
