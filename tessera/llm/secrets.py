"""Secret scanning: fixed patterns plus sliding-window entropy.

Beside three patterns (assignments, access keys, long hex runs) the scan slides
a window over every candidate string, a maximal run of characters of one class,
and keeps the Shannon entropy of the window up to date by incremental counts.
Runs of one case and digits must change between letters and digits three times;
runs of 12 to 19 characters, without a sign beside them, have windows of 12.
Windows at or above the class's threshold merge into spans of kind ``entropy``,
unless a URL or an allow-list pattern covers them.  Scanning is one pass per text without
a shuffle; it runs in Arrow-fed Python because offsets are in code points.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Characters of a candidate, the window and the bits per character that count as random."""

    name: str
    run: str
    needs: tuple[str, ...]
    window: int
    bits: float


#: Three changes between letters and digits, which words with a number at one end do not have.
_LOWER = r"[a-z][0-9]+[a-z]+[0-9]|[0-9][a-z]+[0-9]+[a-z]"
_UPPER = r"[A-Z][0-9]+[A-Z]+[0-9]|[0-9][A-Z]+[0-9]+[A-Z]"


def _short(chars: str) -> str:
    """A whole run of 12 to 19 of the characters."""
    return rf"(?<![{chars}])[{chars}]{{12,19}}(?![{chars}])"


CLASSES = (
    CharClass("hex", r"[0-9a-fA-F]{20,}", (r"[0-9]", r"[a-fA-F]"), 20, 3.0),
    CharClass("base64", r"[A-Za-z0-9+/_=-]{20,}", (r"[0-9]", r"[A-Z]", r"[a-z]"), 20, 3.8),
    CharClass("lower", r"[a-z0-9]{20,}", (_LOWER,), 20, 3.4),
    CharClass("upper", r"[A-Z0-9]{20,}", (_UPPER,), 20, 3.4),
    CharClass("short lower", _short("a-z0-9"), (_LOWER,), 12, 3.0),
    CharClass("short upper", _short("A-Z0-9"), (_UPPER,), 12, 3.0),
    CharClass("short mixed", _short("A-Za-z0-9"), (r"[0-9]", r"[A-Z]", r"[a-z]"), 12, 3.25),
)
#: What is never reported by entropy, beside anything inside a URL: UUIDs.
ALLOW = (r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b",)
_REST_OF_URL = re.compile(r"[^\s\"'<>]+")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")

_CANDIDATE_BYTE = np.zeros(256, bool)
_CANDIDATE_BYTE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def url_spans(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each URL: a lower-case letter, scheme characters, ://, and what follows up to
    white space, a quote or an angle bracket.  Time is linear: schemes are read back from the ://."""
    done, at = 0, text.find("://")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _SCHEME:
            start -= 1
        while start < at and not "a" <= text[start] <= "z":
            start += 1
        rest = _REST_OF_URL.match(text, at + 3) if start < at else None
        if rest:
            yield start, rest.end()
        done = rest.end() if rest else at + 3
        at = text.find("://", done)


def random_windows(s: str, window: int, bits: float) -> Iterator[tuple[int, int]]:
    """Merged (start, end) of the windows of ``s`` with at least ``bits`` of entropy a character."""
    cost = [0.0, *(c * math.log2(c) for c in range(1, window + 2))]  # a window has one more while it moves
    counts: dict[str, int] = {}
    total, begin, end = 0.0, -1, -1
    for i, c in enumerate(s):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += cost[k + 1] - cost[k]
        if i >= window:
            out = s[i - window]
            k = counts[out]
            counts[out] = k - 1
            total += cost[k - 1] - cost[k]
        if i >= window - 1 and math.log2(window) - total / window >= bits - 1e-9:
            if i - window + 1 > end:
                if end >= 0:
                    yield begin, end
                begin = i - window + 1
            end = i + 1
    if end >= 0:
        yield begin, end


class Scanner:
    """Finds the spans (start, kind number, end) of one text."""

    def __init__(self, classes: Sequence[CharClass] = CLASSES, allow: Sequence[str] = ALLOW):
        self.classes = [(re.compile(c.run), [re.compile(n) for n in c.needs], c) for c in classes]
        self.allow = [re.compile(a) for a in allow]
        self.least = min([ACCESS_LEAST, *(c.window for c in classes)])

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        low = text.lower()
        if any(w in low for w in ("passw", "secret", "token", "api")):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def entropy(self, text: str) -> list[tuple[int, int, int]]:
        spans: list[tuple[int, int]] = []
        for run, needs, c in self.classes:
            for m in run.finditer(text):
                for a, b in random_windows(m[0], c.window, c.bits):
                    if all(n.search(m[0], a, b) for n in needs):
                        spans.append((m.start() + a, m.start() + b))
        if not spans:
            return []
        allowed = sorted([*url_spans(text), *(m.span() for p in self.allow for m in p.finditer(text))])
        starts, reach = [x for x, _ in allowed], list(accumulate((y for _, y in allowed), max))
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            k = bisect_right(starts, a)
            if k and reach[k - 1] >= b:  # some allowed span begins no later and ends no earlier
                continue
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return [(a, 3, b) for a, b in merged]

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans, each ordered by start and then kind."""
        if not has_long_run(text, self.least):
            base = sorted(x for x in self._short(text))
            return base, base
        base = self.base(text)
        return base, sorted(base + self.entropy(text))

    def _short(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Base spans of a text without a run long enough for a key, hex run or window: only assignments fit."""
        low = text.lower()
        if any(w in low for w in ("passw", "secret", "token", "api")):
            yield from ((m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST)


def has_long_run(text: str, least: int) -> bool:
    """Whether some run of candidate characters is long enough for a key, hex run or window."""
    d = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    gaps = np.flatnonzero(~_CANDIDATE_BYTE[d])
    if not len(gaps):
        return len(d) >= least
    return bool(gaps[0] >= least or len(d) - 1 - gaps[-1] >= least or (np.diff(gaps) > least).any())


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_RESULT = T.StructType([T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])


def scan_secrets(
    df: DataFrame, text_col: str = "text", classes: Sequence[CharClass] = CLASSES, allow: Sequence[str] = ALLOW
) -> DataFrame:
    """``df`` with ``secret_base`` and ``secret_spans``: comma-joined kind:start:end.

    Offsets count code points, ends are exclusive, order is by start and then
    kind (assign, access, hex, entropy).  Spans of different kinds may overlap;
    base spans are never suppressed.  Null and empty texts have no spans.  Texts
    of any length are scanned whole.  Repeated rows give equal spans, an empty
    table an empty result.
    Columns of ``df`` with those two names are replaced; all others pass through.
    """

    @F.pandas_udf(_RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        scanner = Scanner(classes, allow)
        pairs = [scanner.scan(t) if t else ([], []) for t in texts]
        return pd.DataFrame({"base": [joined(b) for b, _ in pairs], "spans": [joined(s) for _, s in pairs]})

    found = df.withColumn("__secrets", run(df[text_col]))
    return found.withColumns(
        {"secret_base": F.col("__secrets.base"), "secret_spans": F.col("__secrets.spans")}
    ).drop("__secrets")
