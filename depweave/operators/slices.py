"""Slices: groups of types or modules named by a pattern, and the edges between them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions import regex
from depweave.operators.graph import Graph, components


@dataclass(frozen=True)
class SlicePattern:
    """``prefix(*)`` or ``prefix(**)postfix``; both name a slice by what follows the prefix."""

    prefix: str
    postfix: str
    sep: str
    segments: int | None = None
    ignore: tuple[str, ...] = ()
    where: str | None = None


def parse(pattern: str, segments: int | None = None, ignore: Sequence[str] = (), where: str | None = None) -> SlicePattern:
    """L1. A pattern has ``(*)`` or ``(**)``, not both, and ``(**)`` once."""
    one, many = "(*)" in pattern, "(**)" in pattern
    if one == many:
        raise ValueError("a slice pattern needs (*) or (**), and not both")
    if pattern.count("(**") > 1:
        raise ValueError("a slice pattern can have (**) only once")
    sep = "/" if "/" in pattern else "."
    at = pattern.index("(*")
    return SlicePattern(pattern[:at], pattern[pattern.index("*)") + 2 :] if many else sep, sep, segments, tuple(ignore), where)


def slice_name(c: Column, s: SlicePattern) -> Column:
    """The slice a name lies in, null for none.

    A prefix that begins with the separator may stand anywhere, a postfix
    that ends with it too; a name that fits but has no postfix to cut at is an error.
    """
    anywhere = s.prefix.startswith(s.sep)
    pre = s.prefix[len(s.sep) :] if anywhere else s.prefix
    fits = c.contains(pre) if anywhere else c.startswith(pre)
    after = F.substring(c, F.instr(c, pre) + F.lit(len(pre)), F.length(c)) if pre else c
    loose = s.postfix.endswith(s.sep)
    post = s.postfix[: -len(s.sep)] if loose else s.postfix
    fits = fits & (after.contains(post) if loose else c.endswith(post))
    name = F.regexp_replace(after, f"^{regex.escape(s.sep)}+", "") if pre else c
    if post:
        bad = F.raise_error(F.concat(F.lit("no slice for "), c)).cast("string")
        name = F.when(~name.contains(post), bad).otherwise(F.substring_index(name, F.lit(post), 1) if isinstance(post, Column) else F.substring(name, F.lit(1), F.instr(name, post) - 1))
    if s.segments:
        name = F.substring_index(name, s.sep, s.segments)
    out = F.when(fits, name)
    if s.ignore:
        out = F.when(out.isin(list(s.ignore)), F.lit(None).cast("string")).otherwise(out)
    return F.when(regex.matches(c, s.where), out) if s.where else out


def slice_edges(g: Graph, s: SlicePattern) -> DataFrame:
    """(from, to, members): edges between different slices with the member edges behind each, sorted."""
    e = g.edges.where(~F.coalesce("coreModule", F.lit(False)) & ~F.coalesce("couldNotResolve", F.lit(False)))
    local = g.modules.select(F.col("source").alias("resolved"))
    e = e.join(local, "resolved", "left_semi").select("source", "resolved", slice_name(F.col("source"), s).alias("from"), slice_name(F.col("resolved"), s).alias("to"))
    e = e.where("`from` != `to`").select("from", "to", F.concat_ws(" -> ", "source", "resolved").alias("m"))
    return e.groupBy("from", "to").agg(F.array_sort(F.collect_set("m")).alias("members"))


def type_slice_edges(types: DataFrame, dependencies: DataFrame, s: SlicePattern) -> DataFrame:
    """The same for types, which are sliced by their namespace."""
    own = types.where(~F.coalesce("referenced", F.lit(False))).select("fullName", F.explode("namespaces").alias("ns"))
    name = own.select("fullName", slice_name(F.col("ns"), s).alias("slice")).where("slice is not null")
    e = dependencies.select("source", "target").join(name.select(F.col("fullName").alias("source"), F.col("slice").alias("from")), "source").join(name.select(F.col("fullName").alias("target"), F.col("slice").alias("to")), "target")
    return e.where("`from` != `to`").groupBy("from", "to").agg(F.array_sort(F.collect_set(F.concat_ws(" -> ", "source", "target"))).alias("members"))


# What a slice is made of in each language.
UNITS = {"dotnet": "type", "typescript": "module", "javascript": "module", "python": "module"}


def diagram_name(c: Column, s: SlicePattern) -> Column:
    """The slice as diagrams name it: with the prefix it lies below (L10); null for none."""
    return F.concat(F.lit(s.prefix.strip(s.sep) + s.sep if s.prefix.strip(s.sep) else ""), slice_name(c, s))


def not_depend_on_each_other(edges: DataFrame) -> DataFrame:
    """One finding per slice with edges to others."""
    return edges.groupBy(F.col("from").alias("slice")).agg(F.array_sort(F.collect_set("to")).alias("targets"), F.sum(F.size("members")).alias("edges"))


def free_of_cycles(edges: DataFrame) -> DataFrame:
    """(component, slices, edges): one finding per cycle of slices with the edges inside it."""
    pairs = edges.select(F.col("from").alias("src"), F.col("to").alias("dst"))
    scc = components(pairs)
    inside = edges.join(scc.select(F.col("node").alias("from"), "scc"), "from").join(scc.select(F.col("node").alias("to"), F.col("scc").alias("s2")), "to").where("scc = s2")
    return inside.groupBy("scc").agg(F.array_sort(F.collect_set("from")).alias("slices"), F.sum(F.size("members")).alias("edges")).select(F.element_at("slices", 1).alias("component"), "slices", "edges")


def findings(edges: DataFrame, cycles: DataFrame, rule: str, severity: str) -> DataFrame:
    """Slice findings: pairs of slices, and cycles by their first two names."""
    base = lambda df, a, b: df.select(F.lit("slice").alias("type"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), a.alias("from"), b.alias("to"))
    return base(edges, F.col("from"), F.col("to")).unionByName(base(cycles, F.element_at("slices", 1), F.element_at("slices", 2)))


def numbered(edges: DataFrame) -> DataFrame:
    """Slice edges with a position per slice."""
    return edges.withColumn("ord", F.row_number().over(Window.partitionBy("from").orderBy("to")) - 1)
