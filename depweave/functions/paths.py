"""Path expressions (F10, Z6): canonical spelling, dirname, parents. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_form(c: Column) -> Column:
    """Repository-relative posix form of a path; null stays null.

    Surrounding blanks go, backslashes become slashes, runs of slashes become
    one, and leading ``./`` go. Letter case stays.
    """
    x = F.translate(F.btrim(c, F.lit(" \t\r\n\f\u000b\u00a0")), "\\", "/")
    return F.regexp_replace(F.regexp_replace(x, "/{2,}", "/"), r"^(\./)+", "")


def path_form_sql(c: str) -> str:
    """The same in DuckDB's SQL."""
    blank = "' '||chr(9)||chr(13)||chr(10)||chr(12)||chr(11)||chr(160)"
    return f"regexp_replace(regexp_replace(replace(trim({c},{blank}),chr(92),'/'),'/+','/','g'),'^(\\./)+','')"


def path_set(c: Column) -> Column:
    """Sorted set of path forms in an array; null entries are left out, null counts as empty."""
    return F.coalesce(
        F.array_sort(F.array_distinct(F.array_compact(F.transform(c, path_form)))), F.array().cast("array<string>")
    )


def name_set(c: Column) -> Column:
    """Sorted set of an array's entries; null entries are left out, null counts as empty."""
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(c))), F.array().cast("array<string>"))


def dirname(c: Column) -> Column:
    """posix dirname (F10): ``.`` where there is no slash, ``/`` for a file in the root."""
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(~c.rlike("/[^/]"), F.when(c.rlike("^/"), "/").otherwise("."))
        .when(c.rlike("^/+[^/]+/*$"), "/")
        .otherwise(F.regexp_replace(c, "/+[^/]+/*$", ""))
    )


def parents(c: Column) -> Column:
    """``a/b/c`` -> [a, a/b, a/b/c] (A1)."""
    parts = F.split(c, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def normalize_dots(c: Column) -> Column:
    """Resolve ``.`` and ``..`` parts (Z6); a ``..`` that leaves the root is kept."""
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    done = F.aggregate(
        parts,
        empty,
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("..")) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.when(c.startswith("/"), "/").otherwise(""), F.array_join(done, "/"))
