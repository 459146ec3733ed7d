"""Secret scanner with credential linking.

Strong findings are reported by pattern alone. Weak parts (endpoints, unlabelled random strings)
are reported only where the parts that complete a credential lie in the same scope: parts
of one document are intervals that reach ``reach`` characters to both sides; an interval join finds, for
each weak part, whether each of the kinds it needs meets it. Scopes never leave a document, so
the join is done where the text is read, by a binary search in sorted starts and running ends.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns of the strong findings, in the order in which ties are listed.
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words of which one must be in the text, in lower case, for an assignment.
HINTS = ("passw", "secret", "token", "api_key", "apikey")
#: Weak parts.
#: URLs, hosts with a port, IPv4 addresses, and hosts of three labels or more, in either case.
ENDPOINT = re.compile(
    r"(?ai:\b[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]{4,}"
    r"|(?<![a-z0-9.-])(?=[0-9.-]*[a-z])[a-z0-9.-]++:[0-9]{2,5}(?![0-9])"
    r"|(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?::[0-9]{1,5})?(?![0-9]|\.[0-9])"
    r"|(?<![a-z0-9-])(?:[a-z0-9-]{1,63}\.){2,126}[a-z]{2,63}(?![a-z0-9-]))"
)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")

KINDS = ("assign", "access", "hex", "random", "endpoint")
#: What must meet a weak part: one kind of each group.
NEEDS = {"random": (("access", "endpoint"),), "endpoint": (("access",), ("assign", "hex", "random"))}

Span = tuple[int, int, int]  # start, number of the kind, end


def strong(text: str) -> list[Span]:
    """Findings by pattern alone; those that are too short are dropped after they were matched."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _bits(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _mixed(value: str) -> bool:
    """Whether half of a run lies in parts that mix letters with digits, or cases; parts of paths and names are words or numbers."""
    parts = re.findall("[A-Za-z0-9]+", value)
    mixed = [p for p in parts if not p.isalpha() and not p.isdigit() or not (p.isdigit() or p.islower() or p.isupper() or p.istitle())]
    return 2 * sum(map(len, mixed)) >= sum(map(len, parts))


def randoms(text: str, base: list[Span]) -> list[Span]:
    """Random strings outside the strong findings."""
    if max(map(len, text.split()), default=0) < 20:
        return []
    starts, ends, found = [s for s, _, _ in base], [], []
    for _, _, end in base:
        ends.append(max(end, ends[-1]) if ends else end)
    for m in RANDOM.finditer(text):
        before = bisect_left(starts, m.end()) - 1
        value = m.group()
        if (before < 0 or ends[before] <= m.start()) and _bits(value) >= 3.5 and any(map(str.isdigit, value)) and any(map(str.isalpha, value)) and _mixed(value):
            found.append((m.start(), 3, m.end()))
    return found


def weak(text: str, base: list[Span]) -> list[Span]:
    """Random strings and endpoints; no endpoints where no part is that could meet them."""
    found = randoms(text, base)
    if found or any(kind == 1 for _, kind, _ in base):
        found += [(m.start(), 4, m.end()) for m in ENDPOINT.finditer(text)] if "." in text or ":" in text else []
    return sorted(found)


def linked(base: list[Span], candidates: list[Span], reach: int) -> list[Span]:
    """Weak parts that all the kinds they need lie within ``reach`` of; kinds are joined one by one, without pairs.

    Parts that overlap do not complete each other: a path is no secret because of the address that it belongs to.
    """
    places: dict[str, tuple[list[int], list[int]]] = {}
    for start, kind, end in [*base, *candidates]:
        starts, ends = places.setdefault(KINDS[kind], ([], []))
        starts.append(start)
        ends.append(end)
    for starts, ends in places.values():
        starts.sort()
        ends.sort()

    def meets(kind: str, start: int, end: int) -> bool:
        starts, ends = places.get(kind, ([], []))
        after, before = bisect_left(starts, end), bisect_right(ends, start) - 1
        return after < len(starts) and starts[after] <= end + reach or before >= 0 and ends[before] >= start - reach

    return [
        (start, kind, end) for start, kind, end in candidates
        if all(any(meets(k, start, end) for k in group) for group in NEEDS[KINDS[kind]])
    ]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def with_secrets(docs: DataFrame, text_col: str = "text", reach: int = 200, into: str = "secrets") -> DataFrame:
    """Adds a struct: n_assign, n_access, n_hex, n_linked, base_sha256, spans; all rows and columns stay.

    Spans are kind:start:end in code points, end exclusive, by start and then by kind. A
    missing or empty text has no spans. Repeated rows get the same result.
    """

    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for text in batch:
                base = strong(text or "")
                more = linked(base, weak(text, base), reach) if text else []
                n = Counter(kind for _, kind, _ in base)
                rows.append((n[0], n[1], n[2], len(more), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans"])

    kind = "n_assign bigint, n_access bigint, n_hex bigint, n_linked bigint, base_sha256 string, spans string"
    return docs.withColumn(into, F.pandas_udf(scan, kind).asNondeterministic()(text_col))
