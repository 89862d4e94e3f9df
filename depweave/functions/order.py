"""Orders that need a key: root collation, versions, severities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities from the gravest on.
SEVERITIES = ("error", "warn", "info", "ignore")
# The root collation's order of ASCII, case folded.
COLLATION = "\t\n\r _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$0123456789abcdefghijklmnopqrstuvwxyz"


def collated(c: Column) -> Column:
    """Sort key of the root collation: punctuation, digits, letters; small before capital."""
    return F.collate(c, "UNICODE")


def collation_key(text: str) -> tuple:
    """The same order for driver-side lists; characters beyond ASCII follow by code point."""
    first = [(0, COLLATION.index(c.lower())) if c.lower() in COLLATION and c.isascii() else (1, ord(c)) for c in text]
    return first, [c.isascii() and c.isupper() for c in text], text


def severity_rank(c: Column) -> Column:
    """0 for error, 1 warn, 2 info, 3 ignore or anything else."""
    out = F.lit(len(SEVERITIES) - 1)
    for i, s in reversed(list(enumerate(SEVERITIES[:-1]))):
        out = F.when(c == s, i).otherwise(out)
    return out


def _semver(v: str) -> tuple | None:
    m = re.fullmatch(r"v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?", v)
    if not m:
        return None
    parts = tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in m.group(4).split(".")) if m.group(4) else ()
    return (*map(int, m.group(1, 2, 3)), not parts, parts)


def natural_key(v: str) -> list:
    """Runs of digits by value, before runs of text."""
    return [(0, int(r), "") if r.isdigit() else (1, 0, r) for r in re.findall(r"\d+|\D+", v)]


def precedence(a: str, b: str) -> int:
    """-1, 0 or 1: semver precedence if both are semver, else the natural order; build metadata does not count."""
    x, y = _semver(a), _semver(b)
    if x is None or y is None:
        x, y = natural_key(a), natural_key(b)
    return (x > y) - (x < y)


def sort_versions(versions: list[str]) -> list[str]:
    """Oldest first; by semver only if every one is semver, ties by text."""
    key = _semver if all(_semver(v) for v in versions) else natural_key
    return sorted(versions, key=lambda v: (key(v), v))
