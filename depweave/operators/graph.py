"""The dependency graph as two DataFrames, and what is derived from it.

Iterative operators are loops of joins over (source, resolved) pairs. Each
round's result is written to the shared folder, so lineage stays short and a
lost executor costs one round at most; the tables of the rounds go when the
operator ends. Graphs of checked size are searched in one go, see ``local``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions import regex
from depweave.operators import local
from depweave.session import in_sized_partitions, materialize, materialize_counted, scratch

MODULE_COLUMNS = {
    "source": "string", "ord": "bigint", "valid": "boolean", "orphan": "boolean", "followable": "boolean", "matchesDoNotFollow": "boolean", "coreModule": "boolean", "couldNotResolve": "boolean",
    "language": "string", "project": "string", "namespaces": "array<string>", "assemblies": "array<string>", "instability": "double", "license": "string", "size": "bigint", "statements": "bigint",
}
EDGE_COLUMNS = {
    "source": "string", "ord": "bigint", "resolved": "string", "module": "string", "moduleSystem": "string", "dependencyTypes": "array<string>", "dependencyKind": "string", "coreModule": "boolean",
    "followable": "boolean", "dynamic": "boolean", "exoticallyRequired": "boolean", "exoticRequire": "string", "couldNotResolve": "boolean", "circular": "boolean", "valid": "boolean",
    "matchesDoNotFollow": "boolean", "preCompilationOnly": "boolean", "typeOnly": "boolean", "license": "string", "instability": "double", "cycle": "array<struct<name:string,dependencyTypes:array<string>>>", "line": "int",
}
STEP = "struct<name:string,dependencyTypes:array<string>>"


def complete(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns first, absent ones as nulls of their type; others follow."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(c).cast(t) if c.lower() in have else F.lit(None).cast(t)).alias(c) for c, t in columns.items()], *[c for c in df.columns if c not in columns])


@dataclass(frozen=True)
class Graph:
    """Modules keyed by ``source``, edges keyed by (``source``, ``ord``). Order is data: ``ord`` carries it."""

    modules: DataFrame
    edges: DataFrame

    @staticmethod
    def of(edges: DataFrame, modules: DataFrame | None = None) -> "Graph":
        """A graph from an edge table; without modules, every end of an edge is one.

        Rows with a null ``source`` or ``resolved`` are no edges. Of repeated
        modules the last by ``ord`` holds (G1). An edge table without ``ord``
        is ordered by ``resolved`` within its source.
        """
        if "ord" not in edges.columns:
            edges = edges.withColumn("ord", (F.row_number().over(Window.partitionBy("source").orderBy("resolved")) - 1).cast("bigint"))
        e = complete(edges.where("source is not null and resolved is not null"), EDGE_COLUMNS)
        if modules is None:
            flag = lambda c: F.bool_or(F.coalesce(c, F.lit(False))).alias
            ends = e.select("source", F.lit(False).alias("coreModule"), F.lit(False).alias("couldNotResolve"), F.lit(False).alias("matchesDoNotFollow")).unionByName(
                e.select(F.col("resolved").alias("source"), "coreModule", "couldNotResolve", "matchesDoNotFollow")
            )
            modules = ends.groupBy("source").agg(*[flag(F.col(c))(c) for c in ("coreModule", "couldNotResolve", "matchesDoNotFollow")])
        else:
            modules = modules.where("source is not null")
            if "ord" in modules.columns:
                modules = modules.groupBy("source").agg(F.max_by(F.struct(*modules.columns), F.col("ord")).alias("m_")).select("m_.*")
            else:
                modules = modules.dropDuplicates(["source"])
        return Graph(complete(modules, MODULE_COLUMNS), e)

    def with_(self, **kw: DataFrame) -> "Graph":
        return replace(self, **kw)

    def saved(self) -> "Graph":
        """The same graph with both tables written once: for operators that read it several times."""
        return Graph(materialize(self.modules, "modules"), materialize(self.edges, "edges"))

    @property
    def pairs(self) -> DataFrame:
        """Distinct (src, dst) of all edges."""
        return self.edges.select(F.col("source").alias("src"), F.col("resolved").alias("dst")).distinct()


def dependents(g: Graph) -> DataFrame:
    """(source, dependents): distinct importers of each module in byte order."""
    per = g.edges.select(F.col("resolved").alias("source"), F.col("source").alias("dependent")).distinct()
    return per.groupBy("source").agg(F.array_sort(F.collect_list("dependent")).alias("dependents"))


def orphans(g: Graph) -> DataFrame:
    """Modules without dependencies and dependents."""
    m = g.modules.select("source")
    return m.join(g.edges.select("source").distinct(), "source", "left_anti").join(g.edges.select(F.col("resolved").alias("source")).distinct(), "source", "left_anti")


def fan_in(g: Graph) -> DataFrame:
    """Edges per target, not distinct."""
    return g.edges.groupBy("resolved").agg(F.count(F.lit(1)).alias("fan_in"))


def reach(pairs: DataFrame, seeds: DataFrame, depth: int = 0, blocked: DataFrame | None = None) -> DataFrame:
    """(seed, node, level) of everything that seeds reach over at least one edge (G7-G9, G18, A.3).

    ``pairs`` is (src, dst), ``seeds`` is (seed, node) to start from. ``level``
    is the least number of edges; depth 0 is unlimited. A seed is in its own
    set only if it lies on a cycle. Nodes of ``blocked`` (node) are reached
    but not continued from; seeds always continue. A graph that does not fit a
    task is searched by joins, one round per level.
    """
    pairs = materialize(pairs.distinct(), "pairs")
    return local.reach(pairs, seeds, depth, blocked) if local.fits(pairs) else _reach(pairs, seeds, depth, blocked)


@in_sized_partitions
def _reach(pairs: DataFrame, seeds: DataFrame, depth: int, blocked: DataFrame | None) -> DataFrame:
    with scratch() as keep:
        frontier = seeds.select("seed", "node").distinct()
        seen, parts = None, 0
        level = 0
        while True:
            level += 1
            new = frontier.join(pairs, frontier["node"] == pairs["src"]).select("seed", F.col("dst").alias("node")).distinct()
            if seen is not None:
                new = new.join(seen, ["seed", "node"], "left_anti")
            new, n = materialize_counted(new.withColumn("level", F.lit(level)), "reach")
            if not n:
                break
            seen, parts = (new, 1) if seen is None else (seen.unionByName(new), parts + 1)
            if depth and level == depth:
                break
            if parts > 4:  # keep a round's plan small
                seen, parts = materialize(seen, "reach"), 1
            frontier = new.select("seed", "node")
            if blocked is not None:
                frontier = frontier.join(blocked.select("node"), "node", "left_anti").select("seed", "node")
        keep.append(new if seen is None else materialize(seen, "reach"))
        return keep[0]


def meets(pairs: DataFrame, wanted: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """The (seed, node) of ``wanted`` in which the seed reaches the node over at least one edge.

    Beyond a task's size only nodes that lead to a wanted one are walked, and a
    seed's search ends with its last wanted node.
    """
    pairs = materialize(pairs.distinct(), "pairs")
    return local.meets(pairs, wanted, blocked) if local.fits(pairs) else _meets(pairs, wanted, blocked)


@in_sized_partitions
def _meets(pairs: DataFrame, wanted: DataFrame, blocked: DataFrame | None) -> DataFrame:
    with scratch() as keep:
        goals = materialize(wanted.select("seed", "node").distinct(), "goals")
        useful = reach_set(pairs, goals.select("node").distinct(), reverse=True).select(F.col("node").alias("dst"))
        pairs = materialize(pairs.join(useful, "dst", "left_semi").select("src", "dst"), "pairs")
        frontier = goals.select("seed", F.col("seed").alias("node")).distinct()
        seen = met = None
        while True:
            new = frontier.join(pairs, frontier["node"] == pairs["src"]).select("seed", F.col("dst").alias("node")).distinct()
            if seen is not None:
                new = new.join(seen, ["seed", "node"], "left_anti")
            new, n = materialize_counted(new, "reach")
            if not n:
                break
            hit = goals.join(new, ["seed", "node"], "left_semi")
            met = materialize(hit if met is None else met.unionByName(hit), "met")
            unmet = goals.join(met, ["seed", "node"], "left_anti").select("seed").distinct()
            seen = materialize(new if seen is None else seen.unionByName(new), "seen")
            frontier = new.join(unmet, "seed", "left_semi").select("seed", "node")
            if blocked is not None:
                frontier = frontier.join(blocked.select("node"), "node", "left_anti").select("seed", "node")
        keep.append(materialize(goals.limit(0), "met") if met is None else met)
        return keep[0]


def extremes(pairs: DataFrame, seeds: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(node, low, high): the least and the greatest seed that reach each node over at least one edge.

    Tells for every node whether a seed, or a seed other than itself, reaches
    it, with a state of one row per node whatever the number of seeds.
    """
    pairs = materialize(pairs.distinct(), "pairs")
    return local.extremes(pairs, seeds, blocked) if local.fits(pairs) else _extremes(pairs, seeds, blocked)


@in_sized_partitions
def _extremes(pairs: DataFrame, seeds: DataFrame, blocked: DataFrame | None) -> DataFrame:
    with scratch() as keep:
        state = None
        moved = seeds.select(F.col("seed").alias("node"), F.col("seed").alias("low"), F.col("seed").alias("high")).distinct()
        while True:
            cand = moved.join(pairs, moved["node"] == pairs["src"]).select(F.col("dst").alias("node"), "low", "high", F.lit(None).cast("string").alias("l0"), F.lit(None).cast("string").alias("h0"))
            if state is not None:
                cand = cand.unionByName(state.select("node", "low", "high", F.col("low").alias("l0"), F.col("high").alias("h0")))
            best = cand.groupBy("node").agg(*[f(c).alias(c) for f, c in ((F.min, "low"), (F.max, "high"), (F.max, "l0"), (F.max, "h0"))])
            new = ~(F.col("low").eqNullSafe(F.col("l0")) & F.col("high").eqNullSafe(F.col("h0")))
            best, n = materialize_counted(best, "labels", new)
            state = best.select("node", "low", "high")
            if not n:
                break
            moved = best.where(new).select("node", "low", "high")
            if blocked is not None:
                moved = moved.join(blocked.select("node"), "node", "left_anti")
        keep.append(materialize(state, "extremes"))
        return keep[0]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reach_set(pairs: DataFrame, start: DataFrame, depth: int = 0, reverse: bool = False, include: bool = True) -> DataFrame:
    """(node, level) of what a set of nodes reaches as a whole; ``include`` adds the set itself at level 0."""
    if reverse:
        pairs = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    # without single seeds the state is one row per node
    seeds = start.select(F.lit(0).alias("seed"), "node")
    found = reach(pairs, seeds, depth).select("node", "level")
    if include:
        found = found.unionByName(start.select("node").distinct().withColumn("level", F.lit(0)))
    return found.groupBy("node").agg(F.min("level").alias("level"))


def can_reach(pairs: DataFrame, start: str, goal: str) -> bool:
    """Whether ``goal`` is reached from ``start``; stops at the round that finds it."""
    wanted = pairs.sparkSession.createDataFrame([(start, goal)], "seed string, node string")
    return not meets(pairs, wanted).isEmpty()


def _trim(pairs: DataFrame) -> DataFrame:
    """Drop edges from nodes nothing leads to and to nodes that lead nowhere, until none is left or the rest fits a task; they lie on no cycle."""
    n = pairs.count()
    while n > local.PAIRS:
        kept = pairs.join(pairs.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        kept, m = materialize_counted(kept.join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "trim")
        if m == n:
            break
        pairs, n = kept, m
    return pairs


def _spread(pairs: DataFrame, label: DataFrame, combine: Callable[[Column], Column] = F.min) -> DataFrame:
    """Least label that reaches each node, propagated along pairs until nothing changes."""
    while True:
        cand = pairs.join(label, pairs["src"] == label["node"]).select(F.col("dst").alias("node"), "label")
        new = label.withColumn("old", F.col("label")).unionByName(cand.withColumn("old", F.lit(None).cast("string")))
        new, n = materialize_counted(new.groupBy("node").agg(combine("label").alias("label"), F.max("old").alias("old")), "labels", F.col("label") != F.col("old"))
        label = new.select("node", "label")
        if not n:
            return label


def components(pairs: DataFrame) -> DataFrame:
    """(node, scc): strongly connected components of two and more nodes, or of one with an edge to itself.

    A graph that fits a task is searched there, a larger one piece by piece.
    Pieces that fit no task are trimmed of nodes on no cycle, which have no
    row, until they do; what is still larger goes through forward-backward
    colouring: the least name that reaches a node is its colour, a colour's
    component is what leads back to that name within the colour. ``scc`` is
    the least name of the component.
    """
    pairs = materialize(pairs.select("src", "dst").distinct(), "pairs")
    if local.fits(pairs):
        return materialize(local.components(pairs), "components")
    split = local.pieces(pairs)
    if split is None:
        return _components(pairs)
    bins, whole = split
    found = local.components_in_pieces(pairs, bins.where("bin >= 0"))
    if whole:
        return materialize(found, "components")
    with scratch() as keep:
        keep.append(materialize(found.unionByName(_components(local.binned(pairs, bins.where("bin < 0"), "src").select("src", "dst"))), "components"))
        return keep[0]


@in_sized_partitions
def _components(rest: DataFrame) -> DataFrame:
    with scratch() as keep:
        spark = rest.sparkSession
        loops = rest.where("src = dst").select(F.col("src").alias("node"))
        rest = rest.where("src != dst")
        found: list[DataFrame] = []
        while True:
            rest = _trim(materialize(rest, "rest"))
            if local.fits(rest):
                found.append(local.components(rest))
                break
            nodes = rest.select(F.col("src").alias("node")).distinct()
            colour = _spread(rest, nodes.withColumn("label", F.col("node")))
            inside = rest.join(colour.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
            back = materialize(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("a").alias("colour")), "back")
            # what reaches its colour's name against the edges
            got = colour.where("node = label").select("node", F.col("label").alias("scc"))
            frontier = got = materialize(got, "scc")
            while True:
                new = frontier.join(back, (frontier["node"] == back["src"]) & (frontier["scc"] == back["colour"])).select(F.col("dst").alias("node"), "scc").distinct()
                new, n = materialize_counted(new.join(got, "node", "left_anti"), "scc")
                if not n:
                    break
                got, frontier = materialize(got.unionByName(new), "scc"), new
            found.append(got)
            rest = rest.join(got.select(F.col("node").alias("src")), "src", "left_anti").join(got.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        all_ = _union(found) if found else spark.createDataFrame([], "node string, scc string")
        sizes = all_.groupBy("scc").agg(F.count(F.lit(1)).alias("n"))
        real = all_.join(sizes.where("n > 1"), "scc").select("node", "scc")
        keep.append(materialize(real.unionByName(loops.join(real, "node", "left_anti").select("node", F.col("node").alias("scc"))), "components"))
        return keep[0]


#: Edges of a component whose cycles one task searches; more are shared by target among tasks that each hold the component's edges.
EDGES_A_TASK = 10_000
#: Steps of cycles whose names are put in at a time.
STEPS_AT_ONCE = 1_000_000


def first_cycle(adjacency: dict[str, list[tuple[str, list[str]]]], initial: str, current: str, types: list[str]) -> list[tuple[str, list[str]]]:
    """The first cycle through an edge in edge order within one component (A.1), as (name, types) from ``current`` on to ``initial``.

    A step that closes the cycle is taken before any deeper search; targets
    already tried are not tried again; a way that comes back through the node
    it left is dropped. Iterative, so depth is not limited. Once all targets
    of a node were tried, nothing is found by coming to it again.
    """
    tried: set[str] = set()
    done: set[str] = set()

    def enter(node: str, by: list[str]) -> list | tuple:
        es = [(t, ty) for t, ty in adjacency.get(node, ()) if t not in tried]
        for t, ty in es:
            if t == initial:
                return [(t, ty)] if initial == node else [(node, by), (t, ty)]
        return (node, by, iter(es))

    at = enter(current, types)
    if isinstance(at, list):
        return at
    stack = [at]
    while stack:
        node, by, rest = stack[-1]
        step = next(rest, None)
        if step is None:
            done.add(node)
            stack.pop()
            continue
        t, ty = step
        if t in done:
            continue
        tried.add(t)
        down = enter(t, ty)
        if isinstance(down, tuple):
            stack.append(down)
            continue
        # unwind: every node on the stack puts itself before the way found, unless the way holds it already
        way, held = down[::-1], {n for n, _ in down}
        while stack:
            name, how, _ = stack[-1]
            if name in held:
                break
            way.append((name, how))
            held.add(name)
            stack.pop()
        else:
            return way[::-1]
    return []


def first_types(adjacency: dict[str, list[tuple[str, list[str]]]]) -> dict[str, dict[str, list[str]]]:
    """The targets of each node in edge order, each once, with the types of the first edge to it."""
    out: dict[str, dict[str, list[str]]] = {}
    for s, es in adjacency.items():
        own = out[s] = {}
        for t, ty in es:
            own.setdefault(t, ty)
    return out


def first_cycles(adjacency: dict[str, list[tuple[str, list[str]]]], current: str, initials: dict[str, list[str]], first: dict[str, dict[str, list[str]]] | None = None) -> dict[str, list[tuple[str, list[str]]]]:
    """``first_cycle`` for all edges into ``current`` at once; ``initials`` has the types of the edge from each source, ``first`` is ``first_types``.

    The search from a target goes the same way whatever source is looked for,
    until a step to that source is first seen: one search notes for each source
    where that is. A target tried since a node was come to is searched already,
    so each node is come to once, and the target itself a second time. Only a
    source first seen below that second visit, which the rule drops, is looked
    for on its own.
    """
    first = first_types(adjacency) if first is None else first
    none: dict[str, list[str]] = {}
    tried: set[str] = set()
    open_ = set(initials)
    out: dict[str, list[tuple[str, list[str]]]] = {}
    alone: list[str] = []
    stack: list[tuple[str, Iterator]] = []
    way: list[tuple[str, list[str]]] = []  # the steps of the stack
    again = False  # below a second visit of the target

    def enter(node: str, by: list[str]) -> None:
        nonlocal again
        es = first.get(node, none)
        again = again or bool(stack) and node == current
        way.append((node, by))
        for t in [t for t in es if t in open_] if len(es) < len(open_) else [t for t in open_ if t in es]:
            open_.discard(t)
            if again:
                alone.append(t)
            else:
                out[t] = [(t, es[t])] if t == current else [(current, initials[t]), *way[1:], (t, es[t])]
        stack.append((node, filterfalse(tried.__contains__, es)))

    enter(current, [])
    while stack and open_:
        node, rest = stack[-1]
        step = next(rest, None)
        if step is None:
            if len(stack) > 1 and node == current:
                again = False
            stack.pop()
            way.pop()
            continue
        tried.add(step)
        enter(step, first[node][step])
    for s in alone:
        out[s] = first_cycle(adjacency, s, current, initials[s])
    return out


def cycles(g: Graph, scc: DataFrame | None = None, exact_edges: int | None = None, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """(source, ord, cycle) of the edges that lie on a cycle (G4, G5): steps from the target on, back to the source.

    The first cycle in the order of the edges, whatever the size of the
    component. The search needs a component's edges in one place; beyond
    ``edges_a_task`` its targets are shared among several tasks, to each of
    which the edges are sent, so results do not depend on it. Only a caller
    that names ``exact_edges`` gets a shortest cycle instead, by distributed
    breadth-first search, in components of more edges than that.
    """
    scc = components(g.pairs) if scc is None else scc
    e = g.edges.select("source", "ord", "resolved", "dependencyTypes")
    inside = e.join(scc.select(F.col("node").alias("source"), "scc"), "source").join(scc.select(F.col("node").alias("resolved"), F.col("scc").alias("scc2")), "resolved").where("scc = scc2").drop("scc2")
    inside = materialize(inside, "cyclic")
    size = inside.groupBy("scc").agg(F.count(F.lit(1)).alias("n"))
    here = size if exact_edges is None else size.where(F.col("n") <= exact_edges)
    shares = here.select("scc", F.ceil(F.col("n") / edges_a_task).cast("int").alias("shares"))
    sent = inside.join(shares, "scc").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))

    kind = pa.schema([("source", pa.string()), ("ord", pa.int64()), ("cycle", pa.list_(pa.struct([("name", pa.string()), ("dependencyTypes", pa.list_(pa.string()))])))])

    def search(t: pa.Table) -> pa.Table:
        t = t.sort_by([("source", "ascending"), ("ord", "ascending")])
        share, shares = t.column("share")[0].as_py(), t.column("shares")[0].as_py()
        source, resolved, types = (t.column(c).combine_chunks().cast(k) for c, k in (("source", pa.string()), ("resolved", pa.string()), ("types", pa.list_(pa.string()))))
        steps = pa.StructArray.from_arrays([resolved, types], fields=list(kind.field("cycle").type.value_type))
        # a step is told by the number of its edge; names and types are put in when the cycles are known
        ends = list(zip(source.to_pylist(), resolved.to_pylist()))
        adjacency: dict[str, list[tuple[str, int]]] = {}
        for i, (s, to) in enumerate(ends):
            adjacency.setdefault(s, []).append((to, i))
        first = first_types(adjacency)
        # edges into one target are searched together; the first of those between two modules gives the types
        into: dict[str, dict[str, int]] = {}
        for s, es in first.items():
            for to, i in es.items():
                if zlib.crc32(to.encode("utf-8", "surrogatepass")) % shares == share:
                    into.setdefault(to, {})[s] = i
        found: dict[tuple[str, str], np.ndarray] = {}
        for to, initials in into.items():
            for s, way in first_cycles(adjacency, to, initials, first).items():
                found[(s, to)] = np.array([i for _, i in way], np.int32)
        parts, held, n = [], [], 0
        for i, e in enumerate(ends):
            if len(found.get(e, ())):
                held.append((i, found[e]))
                n += len(found[e])
            if held and (n > STEPS_AT_ONCE or i + 1 == len(ends)):
                rows = pa.array([r for r, _ in held])
                way = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(w) for _, w in held]]).astype(np.int32)), steps.take(pa.array(np.concatenate([w for _, w in held]))))
                parts.append(pa.Table.from_arrays([source.take(rows), t.column("ord").combine_chunks().cast(pa.int64()).take(rows), way], schema=kind))
                held, n = [], 0
        return pa.concat_tables(parts) if parts else kind.empty_table()

    sent = sent.withColumn("types", F.coalesce("dependencyTypes", F.array().cast("array<string>"))).drop("dependencyTypes")
    found = sent.groupBy("scc", "share").applyInArrow(lambda t: search(t), f"source string, ord long, cycle array<{STEP}>")
    if exact_edges is not None:
        large = size.where(F.col("n") > exact_edges)
        if not large.isEmpty():
            found = found.unionByName(_shortest_cycles(inside.join(large.select("scc"), "scc", "left_semi")))
    return found


@in_sized_partitions
def _shortest_cycles(inside: DataFrame) -> DataFrame:
    """A shortest way back for every edge, by breadth-first search with parents; ties by byte order."""
    edges = materialize(inside.groupBy("source", "resolved").agg(F.min_by("dependencyTypes", "ord").alias("types")), "edges")
    want = edges.select("source", "resolved")
    way = edges.select("source", "resolved", F.col("resolved").alias("at"), F.array(F.struct(F.col("resolved").alias("name"), F.coalesce("types", F.array().cast("array<string>")).alias("dependencyTypes"))).alias("way"))
    done: list[DataFrame] = []
    seen = way.select("source", "resolved", "at")
    while True:
        closed = materialize(way.where("at = source"), "closed")
        done.append(closed)
        way = way.join(closed.select("source", "resolved"), ["source", "resolved"], "left_anti")
        nxt = edges.select(F.col("source").alias("at"), F.col("resolved").alias("to"), F.col("types").alias("ty"))
        way = way.join(nxt, "at").select("source", "resolved", F.col("to").alias("at"), F.concat("way", F.array(F.struct(F.col("to").alias("name"), F.coalesce("ty", F.array().cast("array<string>")).alias("dependencyTypes")))).alias("way"))
        way = way.join(seen, ["source", "resolved", "at"], "left_anti").groupBy("source", "resolved", "at").agg(F.min("way").alias("way"))
        way = materialize(way, "ways")
        if way.isEmpty():
            break
        seen = materialize(seen.unionByName(way.select("source", "resolved", "at")), "seen")
    best = _union(done).select("source", "resolved", F.col("way").alias("cycle"))
    return inside.select("source", "ord", "resolved").join(best, ["source", "resolved"]).select("source", "ord", "cycle")


def mark_circular(g: Graph, exact: bool = True) -> Graph:
    """Every edge gets ``circular``, cyclic ones ``cycle``. With ``exact`` off an edge inside a component counts as circular, without a cycle."""
    scc = components(g.pairs)
    base = g.edges.drop("circular", "cycle")
    if exact:
        e = base.join(cycles(g, scc), ["source", "ord"], "left").withColumn("circular", F.coalesce(F.size("cycle") > 0, F.lit(False)))
    else:
        a = scc.select(F.col("node").alias("source"), F.col("scc").alias("s1"))
        b = scc.select(F.col("node").alias("resolved"), F.col("scc").alias("s2"))
        e = base.join(a, "source", "left").join(b, "resolved", "left").withColumn("circular", F.coalesce(F.col("s1") == F.col("s2"), F.lit(False))).drop("s1", "s2")
    return g.with_(edges=complete(e, EDGE_COLUMNS))


def same_component(scc: DataFrame, ends: DataFrame) -> DataFrame:
    """(a, b, same) for pairs of names; a name in no cyclic component is only in its own."""
    x = ends.join(scc.select(F.col("node").alias("a"), F.col("scc").alias("sa")), "a", "left").join(scc.select(F.col("node").alias("b"), F.col("scc").alias("sb")), "b", "left")
    return x.select("a", "b", ((F.col("a") == F.col("b")) | F.coalesce(F.col("sa") == F.col("sb"), F.lit(False))).alias("same"))


def first_path(adjacency: dict[str, list[tuple[str, list[str]]]], start: str, goal: str, blocked: set[str] = frozenset()) -> list[tuple[str, list[str]]]:
    """The first path in edge order (A.2): without the start, with the goal; empty if there is none."""
    visited = {start}
    stack: list[tuple[Iterator, tuple | None]] = [(iter(adjacency.get(start, ())), None)]
    while stack:
        t = next(stack[-1][0], None)
        if t is None:
            stack.pop()
            continue
        if t[0] in visited:
            continue
        if t[0] == goal:
            return [s for _, s in stack if s is not None] + [t]
        visited.add(t[0])
        if t[0] in adjacency and t[0] not in blocked:
            stack.append((iter(adjacency[t[0]]), t))
    return []


def paths(g: Graph, ends: DataFrame, blocked: DataFrame | None = None, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """(from, to, via): a shortest path for each pair that has one (G10), from all starts at once.

    Of several shortest paths the one least in byte order of its names is
    given. ``blocked`` (node) is not continued from. With ``wanted``, a start
    whose ``to`` is null looks for all nodes but itself whose name it holds for.
    """
    e = materialize(g.edges.groupBy("source", "resolved").agg(F.min_by("dependencyTypes", "ord").alias("ty")), "edges")
    pairs = e.select(F.col("source").alias("src"), F.col("resolved").alias("dst"))
    if wanted is None and local.fits(pairs):
        return _with_types(local.paths(pairs, ends, blocked), e)
    split = local.pieces(pairs)
    if split is None:
        return _paths(e, _named(pairs, ends, blocked, wanted), blocked)
    bins, whole = split
    out = local.paths_in_pieces(e, ends, bins.where("bin >= 0"), blocked, wanted)
    if whole:
        return out
    large = bins.where("bin < 0")
    e = materialize(local.binned(e, large, "source").drop("piece", "bin"), "edges")
    pairs = e.select(F.col("source").alias("src"), F.col("resolved").alias("dst"))
    return out.unionByName(_paths(e, _named(pairs, local.binned(ends, large, "from").drop("piece", "bin"), blocked, wanted), blocked))


def _named(pairs: DataFrame, ends: DataFrame, blocked: DataFrame | None, wanted: Callable[[Column], Column] | None) -> DataFrame:
    """(from, to) with every ``to`` named: what a start without one reaches of what is wanted."""
    if wanted is None:
        return ends
    seeds = ends.where("`to` is null").select(F.col("from").alias("seed"), F.col("from").alias("node"))
    met = reach(pairs, seeds, blocked=blocked).where(wanted(F.col("node")) & (F.col("seed") != F.col("node")))
    return ends.where("`to` is not null").select("from", "to").unionByName(met.select(F.col("seed").alias("from"), F.col("node").alias("to")))


def _with_types(ways: DataFrame, e: DataFrame) -> DataFrame:
    """Ways of names as ways of steps: each with the types of the first edge that leads to it."""
    none = F.array().cast("array<string>")
    steps = ways.select("from", "to", F.posexplode("way").alias("p", "name"), F.concat(F.array("from"), "way").alias("w")).select("from", "to", "p", "name", F.get("w", F.col("p")).alias("source"))
    steps = steps.join(e.select("source", F.col("resolved").alias("name"), "ty"), ["source", "name"])
    step = F.struct("p", F.struct("name", F.coalesce("ty", none).alias("dependencyTypes")).alias("s"))
    return steps.groupBy("from", "to").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["s"]).alias("via"))


@in_sized_partitions
def _paths(e: DataFrame, ends: DataFrame, blocked: DataFrame | None) -> DataFrame:
    step = lambda n, t: F.array(F.struct(F.col(n).alias("name"), F.coalesce(F.col(t), F.array().cast("array<string>")).alias("dependencyTypes")))
    goals = materialize(ends.select("from", "to").distinct(), "goals")
    starts = goals.select(F.col("from").alias("seed")).distinct()
    way = starts.join(e, starts["seed"] == e["source"]).select("seed", F.col("resolved").alias("at"), step("resolved", "ty").alias("via"))
    seen, done = None, []
    while True:
        way = materialize(way.groupBy("seed", "at").agg(F.min("via").alias("via")), "ways")
        if way.isEmpty():
            break
        done.append(way.join(goals, (goals["from"] == way["seed"]) & (goals["to"] == way["at"])).select("from", "to", "via"))
        seen = way.select("seed", "at") if seen is None else materialize(seen.unionByName(way.select("seed", "at")), "seen")
        front = way if blocked is None else way.join(blocked.select(F.col("node").alias("at")), "at", "left_anti")
        way = front.join(e, front["at"] == e["source"]).select("seed", F.col("resolved").alias("to_"), F.concat("via", step("resolved", "ty")).alias("via")).withColumnRenamed("to_", "at").join(seen, ["seed", "at"], "left_anti")
    return _union(done) if done else e.sparkSession.createDataFrame([], f"`from` string, `to` string, via array<{STEP}>")


def select_nodes(g: Graph, path: str | None, path_not: str | None = None) -> DataFrame:
    """(node) of the modules whose source matches ``path`` and not ``pathNot``."""
    s = F.col("source")
    cond = F.lit(True)
    if path:
        cond = cond & regex.matches(s, path)
    if path_not:
        cond = cond & ~regex.matches(s, path_not)
    return g.modules.where(cond).select(s.alias("node"))
