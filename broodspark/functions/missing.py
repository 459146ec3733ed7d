"""Missing-value rules as SQL expressions: a missing input makes the result missing."""

from __future__ import annotations


def strict(aggregate: str, column: str, over: str = "") -> str:
    """``aggregate``, or NULL as soon as one value of ``column`` in the group is NULL."""
    return f"CASE WHEN count({column}) {over} = count(1) {over} THEN {aggregate} {over} END"


def running_sum(column: str, so_far: str) -> str:
    """Running sum that stays NULL from the first NULL on (plain ``sum`` would skip it)."""
    return strict(f"sum({column})", column, so_far)


def ratio(numerator: str, denominator: str) -> str:
    """Division that is NULL at a zero denominator instead of failing."""
    return f"try_divide({numerator}, {denominator})"


def half_even(expression: str, digits: int = 0) -> str:
    """Rounding with ties to the even neighbour."""
    return f"bround({expression}, {digits})"
