"""JavaScript patterns for Spark's Java regex engine (P1, P2, P31-P35, Z1, Z2, Z5). All of it at plan time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# JavaScript's line ends and white space, as members of a Java character class.
LINE_ENDS = r"\n\r\u2028\u2029"
SPACES = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
# The characters an escaped literal needs a backslash before.
SPECIAL = r"\^$.*+?()[]{}|/"
MARK = "\uE000"
#: Nested unbounded repetition and the largest repetition count that is accepted.
MAX_REPEATS, MAX_COUNT = 25, 10_000


class PatternError(ValueError):
    """A pattern that JavaScript or this engine refuses."""


def join(patterns: str | Iterable[str] | None) -> str | None:
    """One pattern from one or many (P1); an empty one is no restriction."""
    if patterns is None:
        return None
    p = patterns if isinstance(patterns, str) else "|".join(patterns)
    return p or None


def escape(text: str) -> str:
    return "".join("\\" + c if c in SPECIAL else c for c in text)


def _escape_sequence(p: str, i: int, in_class: bool) -> tuple[str, int]:
    """Java form of the escape at ``p[i]`` and the position after it."""
    c = p[i + 1]
    if c in "dDwWtnfr":
        return "\\" + c, i + 2
    if c == "s":
        return (SPACES if in_class else f"[{SPACES}]"), i + 2
    if c == "S":
        return (f"&&[^{SPACES}]" if in_class else f"[^{SPACES}]"), i + 2
    if c == "v":
        return r"\x0B", i + 2
    if c == "b":
        return (r"\x08", i + 2) if in_class else (r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))", i + 2)
    if c == "B" and not in_class:
        return r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))", i + 2
    if c == "0":
        return r"\x00", i + 2
    if c.isdigit() and not in_class:
        return "\\" + c, i + 2
    m = re.compile(r"x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|c([A-Za-z])").match(p, i + 1)
    if m:
        code = int(m.group(1) or m.group(2), 16) if not m.group(3) else ord(m.group(3).upper()) & 31
        return f"\\x{{{code:X}}}", m.end()
    if c == "k" and not in_class and (m := re.compile(r"k<([A-Za-z][A-Za-z0-9]*)>").match(p, i + 1)):
        return f"\\k<{m.group(1)}>", m.end()
    # an escaped letter is the letter; anything else stays escaped
    return (c if c.isalpha() else "\\" + c), i + 2


@lru_cache(maxsize=4096)
def to_java(p: str) -> str:
    """A JavaScript pattern (no flags) with the same meaning in Java. Lookaround is refused."""
    out: list[str] = []
    i, n = 0, len(p)
    while i < n:
        c = p[i]
        if c == "\\":
            if i + 1 == n:
                raise PatternError(f"pattern ends with a backslash: {p}")
            s, i = _escape_sequence(p, i, False)
            out.append(s)
        elif c == "[":
            s, i = _class(p, i)
            out.append(s)
        elif c == "(" and re.compile(r"\(\?(=|!|<=|<!)").match(p, i):
            raise PatternError(f"lookaround is not accepted: {p}")
        elif c == ".":
            out.append(f"[^{LINE_ENDS}]")
            i += 1
        elif c == "$":
            out.append(r"\z")
            i += 1
        elif c == "{" and not re.compile(r"\{\d+(,\d*)?\}").match(p, i):
            out.append(r"\{")
            i += 1
        elif c == "{":
            end = p.index("}", i) + 1
            out.append(p[i:end])
            i = end
        elif c == "}":
            out.append(r"\}")
            i += 1
        elif c == "]":
            out.append(r"\]")
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _class(p: str, i: int) -> tuple[str, int]:
    n, j = len(p), i + 1
    negated = j < n and p[j] == "^"
    j += negated
    if j < n and p[j] == "]":
        return ("[\\s\\S]" if negated else "(?:(?!))"), j + 1
    out: list[str] = []
    while True:
        if j >= n:
            raise PatternError(f"unclosed character class: {p}")
        c = p[j]
        if c == "]":
            return f"[{'^' if negated else ''}{''.join(out)}]", j + 1
        if c == "\\" and j + 1 < n:
            s, j = _escape_sequence(p, j, True)
            out.append(s)
        else:
            out.append("\\" + c if c in "[&~^" else c)
            j += 1


def groups(p: str) -> list[bool]:
    """For each capturing group whether it may take no part in a match (it is optional, or in an alternative)."""
    i, next_id, in_class = 0, 1, False
    marks = [0]  # open groups, capturing or not; 0 is the pattern itself
    optional: dict[int, bool] = {}
    alternates, up = {0: False}, {0: 0}
    owner: list[int] = []
    while i < len(p):
        c = p[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            capturing = p[i + 1 : i + 2] != "?" or (p[i + 2 : i + 3] == "<" and p[i + 3 : i + 4] not in ("=", "!"))
            gid, next_id = next_id, next_id + 1
            up[gid], alternates[gid], optional[gid] = marks[-1], False, False
            marks.append(gid)
            if capturing:
                owner.append(gid)
        elif c == "|":
            alternates[marks[-1]] = True
        elif c == ")" and len(marks) > 1:
            gid = marks.pop()
            optional[gid] = re.compile(r"[?*]|\{0").match(p, i + 1) is not None
        i += 1
    out = []
    for gid in owner:
        maybe, at = False, gid
        while at:
            maybe = maybe or optional[at] or alternates[up[at]]
            at = up[at]
        out.append(maybe)
    return out


def check(p: str) -> list[str]:
    """Warnings about a pattern that could be slow or that is refused."""
    out = []
    try:
        to_java(p)
        re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", p).replace("[^]", r"[\s\S]"))
    except (PatternError, re.error) as e:
        out.append(str(e))
    if len(re.findall(r"(?<!\\)[*+]|\{\d+,?\d*\}", p)) > MAX_REPEATS:
        out.append("too many repetitions")
    if any(int(x) > MAX_COUNT for x in re.findall(r"\{(\d+)", p)):
        out.append("a repetition count is too large")
    if re.search(r"\([^()]*[*+][^()]*\)[*+{]", p):
        out.append("nested unbounded repetition")
    return out


def matches(c: Column, p: str) -> Column:
    """Regex search; null does not match."""
    return F.coalesce(c.rlike(to_java(p)), F.lit(False))


def matches_with(c: Column, p: str, found: Column | None) -> Column:
    """Search for a pattern in which ``$n`` stands for group n of ``found``, an array of captured texts.

    Replacement is textual and in index order; a group that is missing
    leaves its placeholder in place. Without a placeholder the pattern is constant.
    """
    if found is None or not re.search(r"\$\d", p):
        return matches(c, p)
    # private characters mark placeholders through the translation; then the escaped groups go in
    pattern = F.lit(to_java(re.sub(r"\$(\d)", lambda m: MARK + m.group(1) + MARK, p)))
    for d in sorted({int(x) for x in re.findall(r"\$(\d)", p)}):
        group = F.regexp_replace(F.get(found, F.lit(d)), r"([\\^$.*+?()\[\]{}|/])", r"\\$1")
        pattern = F.replace(pattern, F.lit(f"{MARK}{d}{MARK}"), F.coalesce(group, F.lit(rf"\z{d}")))
    return F.coalesce(F.rlike(c, pattern), F.lit(False))


def captured(c: Column, p: str) -> Column | None:
    """The whole match and every participating group of a match (P34); None if the pattern has no groups.

    Groups that may stay out shift later indexes, which the built-in
    extraction cannot tell from an empty match: those go through an
    Arrow-batched function.
    """
    optional = groups(p)
    if not optional:
        return None
    java = to_java(p)
    if not any(optional):
        whole = F.array(*[F.regexp_extract(c, java, k) for k in range(len(optional) + 1)])
        return F.when(c.rlike(java), whole).otherwise(F.array().cast("array<string>"))
    compiled = re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", p).replace("[^]", r"[\s\S]").replace("$", r"\Z"))

    @F.pandas_udf("array<string>")
    def participating(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[str]:
            m = compiled.search(x) if x is not None else None
            return [g for g in (m.group(0), *m.groups()) if g is not None] if m else []

        return s.map(one)

    return participating(c)


def glob_to_pattern(glob: str) -> str:
    """A path glob as an anchored pattern (Z5): ``**`` spans folders, ``*`` and ``?`` stay inside one, ``{a,b}`` are alternatives."""
    out, i, depth = ["^"], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(escape(c))
        i += 1
    return "".join([*out, "$"])


def any_of(preds: Sequence[Column]) -> Column:
    out = F.lit(False)
    for p in preds:
        out = out | p
    return out
