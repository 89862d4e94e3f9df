"""Filters and consolidation of a graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions import regex
from depweave.functions.paths import dirname
from depweave.operators.graph import EDGE_COLUMNS, MODULE_COLUMNS, Graph, complete, reach_set, select_nodes
from depweave.plans.compile import removed
from depweave.plans.rules import GraphView


def _hits(c: str, p: str) -> Column:
    return regex.matches(F.col(c), p)


def exclude(g: Graph, path: str, dynamic: bool | None = None) -> Graph:
    """Without modules and edges whose source or target matches."""
    edges = g.edges.where(~_hits("source", path) & ~_hits("resolved", path))
    if dynamic is not None:
        edges = edges.where(~F.coalesce(F.col("dynamic") == F.lit(dynamic), F.lit(False)))
    return Graph(g.modules.where(~_hits("source", path)), edges)


def include_only(g: Graph, path: str) -> Graph:
    """Only matching modules and their edges into matching targets (F2)."""
    return Graph(g.modules.where(_hits("source", path)), g.edges.where(_hits("source", path) & _hits("resolved", path)))


def do_not_follow(g: Graph, path: str | None = None, types: Sequence[str] | None = None) -> Graph:
    """Edges into what is not followed stay, what lies behind it goes."""
    stop = regex.any_of(
        ([_hits("resolved", path)] if path else []) + ([F.coalesce(F.arrays_overlap("dependencyTypes", F.array(*[F.lit(t) for t in types])), F.lit(False))] if types else [])
    )
    e = g.edges.withColumn("matchesDoNotFollow", F.coalesce(F.col("matchesDoNotFollow"), F.lit(False)) | stop)
    ends = e.where("matchesDoNotFollow").select(F.col("resolved").alias("source")).distinct()
    modules = g.modules.join(ends.withColumn("hit_", F.lit(True)), "source", "left").withColumn("matchesDoNotFollow", F.coalesce(F.col("matchesDoNotFollow"), F.lit(False)) | F.coalesce("hit_", F.lit(False))).drop("hit_")
    return Graph(modules, e.join(ends, "source", "left_anti"))


def max_depth(g: Graph, entry: str, depth: int) -> Graph:
    """What lies within ``depth`` edges of the modules that match ``entry``."""
    near = reach_set(g.pairs, select_nodes(g, entry), depth).select(F.col("node").alias("source"), "level")
    e = g.edges.join(near.where(F.col("level") < depth).select("source"), "source", "left_semi")
    return Graph(g.modules.join(near.select("source"), "source", "left_semi"), e)


def _keep(g: Graph, nodes: DataFrame, tag: str, path: str) -> Graph:
    n = nodes.select(F.col("node").alias("source"))
    modules = g.modules.join(n, "source", "left_semi").withColumn(tag, _hits("source", path))
    edges = g.edges.join(n, "source", "left_semi").join(n.withColumnRenamed("source", "resolved"), "resolved", "left_semi")
    return Graph(modules, edges)


def focus(g: Graph, path: str, depth: int = 1) -> Graph:
    """Matching modules with their neighbourhood in both directions; ``matchesFocus`` tags the matching ones.

    Depth counts edges of shortest ways, 0 is unlimited.
    """
    seeds = select_nodes(g, path)
    out = reach_set(g.pairs, seeds, depth)
    back = reach_set(g.pairs, seeds, depth, reverse=True)
    return _keep(g, out.select("node").unionByName(back.select("node")).distinct(), "matchesFocus", path)


def reaches(g: Graph, path: str, depth: int = 0) -> Graph:
    """Modules that reach a matching one; ``matchesReaches`` tags the matching ones."""
    return _keep(g, reach_set(g.pairs, select_nodes(g, path), depth, reverse=True), "matchesReaches", path)


def highlight(g: Graph, path: str) -> Graph:
    """Tag only; an empty pattern matches everything."""
    return g.with_(modules=g.modules.withColumn("matchesHighlight", regex.matches(F.col("source"), path)))


def apply_filters(g: Graph, options: dict) -> Graph:
    """Filters in their fixed order: exclude, includeOnly, focus, reaches, highlight."""
    if options.get("exclude"):
        g = exclude(g, regex.join(options["exclude"]))
    if options.get("includeOnly"):
        g = include_only(g, regex.join(options["includeOnly"]))
    if options.get("focus"):
        g = focus(g, regex.join(options["focus"]), options.get("focusDepth", 1))
    if options.get("reaches"):
        g = reaches(g, regex.join(options["reaches"]), options.get("reachesDepth", 0))
    if options.get("highlight") is not None:
        g = highlight(g, regex.join(options["highlight"]) or "")
    return g


def collapse_pattern(depth_or_pattern: int | str) -> str:
    """A digit stands for so many folders below packages or the root."""
    s = str(depth_or_pattern)
    return "node_modules/[^/]+|^" + "[^/]+/" * int(s) if s.isdigit() and len(s) == 1 else s


def consolidate(g: Graph, name: Column | None = None, pattern: str | None = None, drop_self: bool = False) -> Graph:
    """Modules merged under new names (F6-F9, F11, A.7).

    Without ``pattern`` the new name is the folder, with it the first match, or
    the old name where nothing matches. Of edges between the same two names
    the first by module and edge order holds; a module's own fields come from
    its last member that has them, ``valid`` is true only if all are.
    """

    def renamed(c: Column) -> Column:
        if pattern is None:
            return dirname(c) if name is None else name
        m = regexp_first(c, pattern)
        return F.when(m != "", m).otherwise(c)

    order = F.struct(F.coalesce("mord", F.lit(0)).alias("m"), F.col("source").alias("s"), F.coalesce("ord", F.lit(0)).alias("o"))
    e = g.edges.join(g.modules.select("source", F.col("ord").alias("mord")), "source", "left")
    e = e.withColumn("new_s", renamed(F.col("source"))).withColumn("new_t", renamed(F.col("resolved")))
    cols = [c for c in EDGE_COLUMNS if c not in ("source", "resolved")]
    first = e.groupBy("new_s", "new_t").agg(F.min_by(F.struct(*cols), order).alias("e_"), F.min(order).alias("ord_"))
    edges = first.select(F.col("new_s").alias("source"), F.col("new_t").alias("resolved"), *[F.col(f"e_.{c}").alias(c) for c in cols if c != "ord"], "ord_")
    edges = edges.withColumn("ord", (F.row_number().over(Window.partitionBy("source").orderBy("ord_")) - 1).cast("bigint")).drop("ord_")
    edges = edges.withColumn("dependencyTypes", F.array_distinct("dependencyTypes"))
    if drop_self:
        edges = edges.where("source != resolved")
    by = F.struct(F.coalesce("ord", F.lit(0)).alias("m"), F.col("source").alias("s"))
    m = g.modules.withColumn("new", renamed(F.col("source")))
    keep = [c for c in MODULE_COLUMNS if c not in ("source", "ord", "valid")]
    modules = m.groupBy("new").agg(
        F.min("ord").alias("ord"), F.bool_and(F.coalesce("valid", F.lit(True))).alias("valid"), F.count(F.lit(1)).alias("members"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), by)).alias(c) for c in keep],
    )
    return Graph(complete(modules.withColumnRenamed("new", "source"), MODULE_COLUMNS).withColumn("consolidated", F.lit(True)), complete(edges, EDGE_COLUMNS))


def regexp_first(c: Column, p: str) -> Column:
    return F.regexp_extract(c, regex.to_java(p), 0)


def unmatched_ignores(g: Graph, view: GraphView) -> list[int]:
    """Entries of a rule's ``ignore`` that match no edge (F18), all counted in one pass."""
    if not view.ignore:
        return []
    s, t, ty = F.col("source"), F.col("resolved"), F.col("dependencyTypes")
    hits = [F.count_if(removed(GraphView(ignore=(entry,)), s, t, ty)).alias(f"i{i}") for i, entry in enumerate(view.ignore)]
    return [i for i, n in enumerate(g.edges.agg(*hits).first()) if not n]


def reset(g: Graph) -> Graph:
    """Without anything an earlier evaluation wrote."""
    return Graph(complete(g.modules.drop("valid", "orphan", "instability", "rules", "dependents"), MODULE_COLUMNS), complete(g.edges.drop("valid", "circular", "cycle", "instability", "rules"), EDGE_COLUMNS))
