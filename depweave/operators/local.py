"""Searches over a graph that fits into one task.

A graph whose distinct pairs stay below ``PAIRS`` rows and ``NAME_BYTES`` bytes
of names is sent to all executors as two arrays, and the seeds are searched in
parallel, each in one go instead of one join per level. Both bounds are checked
before anything is sent. A larger graph whose names fall into pieces that no
way connects (the repositories of a fleet, the runs of a table) is searched
piece by piece, each in a task of its own, see ``pieces``; what fits in neither
way takes the joins of ``graph``. What comes out is the same every way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.session import materialize

PAIRS = 1_000_000
NAME_BYTES = 64 << 20
ROWS_AT_ONCE = 100_000
#: First segments of names, and pairs of them that edges connect, which the driver sorts into pieces.
HEADS = 200_000
#: Small pieces share a bin up to so many pairs; a bin's starts are shared among tasks up to so many pairs, and ways, times starts.
BIN_PAIRS = 100_000
BIN_WORK = 200_000_000
BIN_WAYS = 1_000_000


@dataclass
class Adjacency:
    """Targets of node ``i`` are ``to[first[i] : first[i + 1]]``, in byte order of their names; nodes are numbered in byte order too."""

    names: pa.StringArray
    first: np.ndarray
    to: np.ndarray
    stop: np.ndarray  # nodes that are reached but not continued from

    def numbers(self, names: pa.Array) -> np.ndarray:
        """Numbers of names, -1 for those that are no node."""
        return pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False)

    def after(self, nodes: np.ndarray) -> np.ndarray:
        """Targets of some nodes, one after the other."""
        n = self.first[nodes + 1] - self.first[nodes]
        return self.to[np.repeat(self.first[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(nodes) else self.to[:0]


def fits(pairs: DataFrame) -> bool:
    """Whether (src, dst) pairs, which should be a written table, stay within the bounds."""
    n, size = pairs.agg(F.count(F.lit(1)), F.sum(F.octet_length("src") + F.octet_length("dst"))).first()
    return n <= PAIRS and (size or 0) <= NAME_BYTES


def head(name: Column) -> Column:
    return F.substring_index(name, "/", 1)


def pieces(pairs: DataFrame) -> tuple[DataFrame, bool] | None:
    """((head, piece, bin) of all names that have targets, whether every bin fits a task), None where there are too many heads.

    The head of a name is its first segment. Heads belong together if an edge
    leads from one to a node of the other that has targets itself; a node
    without targets ends every way, so it may lie in many pieces. Thus no way
    leaves a piece, and a pair lies in the piece of its source. A piece beyond
    the bounds has bin -1. ``pairs`` should be a written table.
    """
    heads = pairs.groupBy(head(F.col("src")).alias("head")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("src") + F.octet_length("dst")).alias("size"))
    rows = heads.limit(HEADS + 1).collect()
    cross = pairs.select(head(F.col("src")).alias("a"), head(F.col("dst")).alias("b"), F.col("dst").alias("src")).where("a != b").distinct()
    cross = cross.join(heads.select(F.col("head").alias("b")), "b", "left_semi").join(pairs.select("src"), "src", "left_semi").select("a", "b").distinct().limit(HEADS + 1)
    links = cross.collect() if len(rows) <= HEADS else []
    if max(len(rows), len(links)) > HEADS:
        return None
    of = {r["head"]: r["head"] for r in rows}

    def find(x: str) -> str:
        while of[x] != x:
            of[x] = x = of[of[x]]
        return x

    for a, b in links:
        of[find(a)] = find(b)
    parts: dict[str, list] = {}
    for r in rows:
        parts.setdefault(find(r["head"]), []).append(r)
    told, whole, bin_, n, size = [], True, 0, 0, 0
    for piece, part in enumerate(sorted(parts.values(), key=lambda p: (-sum(r["n"] for r in p), p[0]["head"]))):
        dn, ds = sum(r["n"] for r in part), sum(r["size"] or 0 for r in part)
        if dn > PAIRS or ds > NAME_BYTES:
            told += [(r["head"], piece, -1) for r in part]
            whole = False
            continue
        if n and (n + dn > BIN_PAIRS or size + ds > NAME_BYTES):
            bin_, n, size = bin_ + 1, 0, 0
        n, size = n + dn, size + ds
        told += [(r["head"], piece, bin_) for r in part]
    kind = pa.schema([("head", pa.string()), ("piece", pa.int32()), ("bin", pa.int32())])
    return pairs.sparkSession.createDataFrame(pa.table([[x[i] for x in told] for i in range(3)], schema=kind)), whole


def binned(df: DataFrame, bins: DataFrame, name: str) -> DataFrame:
    """``df`` with the ``piece`` and ``bin`` of the names in a column; rows of names without targets go."""
    return df.join(F.broadcast(bins), head(F.col(name)) == bins["head"]).drop("head")


def _arrays(src: pa.StringArray, dst: pa.StringArray) -> tuple[Adjacency, np.ndarray, np.ndarray]:
    """The pairs as arrays, the number of each one's source, and where each stood before they were put in order."""
    names = pc.unique(pa.concat_arrays([src, dst]))
    names = names.take(pc.sort_indices(names))
    a, b = (pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (src, dst))
    order = np.lexsort((b, a))
    first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(names)))]) if len(names) else np.zeros(1, np.int64)
    return Adjacency(names, first.astype(np.int64), b[order].astype(np.int64), np.zeros(len(names), bool)), a[order], order


def load(pairs: DataFrame, blocked: DataFrame | None = None) -> Adjacency:
    """The pairs as arrays, for a graph that ``fits``; of ``blocked`` (node) only what lies in the graph is read."""
    t = pairs.select("src", "dst").toArrow()
    out, _, _ = _arrays(*(t.column(c).combine_chunks().cast(pa.string()) for c in ("src", "dst")))
    if blocked is not None:
        ends = pairs.select(F.col("src").alias("node"))
        hit = blocked.select("node").distinct().join(ends, "node", "left_semi").toArrow().column("node").combine_chunks().cast(pa.string())
        at = out.numbers(hit)
        out.stop[at[at >= 0]] = True
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.Array]]:
    """(seed, its rows' second column) of batches that are sorted by seed."""
    held, parts = None, []
    for x in batches:
        if not x.num_rows:
            continue
        seeds = x.column(0)
        codes = pc.run_end_encode(seeds)
        start = 0
        for seed, end in zip(codes.values.to_pylist(), codes.run_ends.to_pylist()):
            part = x.column(1).slice(start, end - start)
            start = end
            if parts and seed == held:
                parts.append(part)
                continue
            if parts:
                yield held, pa.concat_arrays(parts)
            held, parts = seed, [part]
    if parts:
        yield held, pa.concat_arrays(parts)


def _search(adj: Adjacency, starts: np.ndarray, depth: int, mark: np.ndarray, stamp: int, until: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """(new nodes, level) level by level; ends early once all of ``until`` are met. ``mark`` holds ``stamp`` for nodes met."""
    front, level = np.unique(starts[starts >= 0]), 0
    while len(front):
        level += 1
        new = adj.after(front)
        new = np.unique(new[mark[new] != stamp])
        if not len(new):
            return
        mark[new] = stamp
        yield new, level
        if depth and level == depth or until is not None and (mark[until] == stamp).all():
            return
        front = new[~adj.stop[new]]


def _by_seed(seeds: DataFrame, column: str) -> DataFrame:
    return seeds.select("seed", column).distinct().repartition("seed").sortWithinPartitions("seed")


def reach(pairs: DataFrame, seeds: DataFrame, depth: int = 0, blocked: DataFrame | None = None) -> DataFrame:
    """(seed, node, level) as ``graph.reach`` gives it."""
    sent = pairs.sparkSession.sparkContext.broadcast(load(pairs, blocked))
    kind = seeds.schema["seed"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adj: Adjacency = sent.value
        mark = np.full(len(adj.names), -1, np.int64)
        held: list[tuple[object, np.ndarray, int]] = []
        rows = 0
        for stamp, (seed, nodes) in enumerate(_groups(batches)):
            for new, level in _search(adj, adj.numbers(nodes.cast(pa.string())), depth, mark, stamp):
                held.append((seed, new, level))
                rows += len(new)
                if rows >= ROWS_AT_ONCE:
                    yield _told(adj, held, seed_type)
                    held, rows = [], 0
        if held:
            yield _told(adj, held, seed_type)

    seed_type = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind.simpleString()]
    return _by_seed(seeds, "node").mapInArrow(run, f"seed {kind.simpleString()}, node string, level int")


def _told(adj: Adjacency, held: list[tuple[object, np.ndarray, int]], seed_type: pa.DataType) -> pa.RecordBatch:
    n = np.array([len(x) for _, x, _ in held])
    which = pa.array(np.repeat(np.arange(len(held)), n))
    cols = [pa.array([s for s, _, _ in held], seed_type).take(which), adj.names.take(pa.array(np.concatenate([x for _, x, _ in held]))), pa.array([v for _, _, v in held], pa.int32()).take(which)]
    return pa.RecordBatch.from_arrays(cols, names=["seed", "node", "level"])


def meets(pairs: DataFrame, wanted: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """The (seed, node) of ``wanted`` in which the seed reaches the node over at least one edge; a search ends with its last wanted node."""
    sent = pairs.sparkSession.sparkContext.broadcast(load(pairs, blocked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adj: Adjacency = sent.value
        mark = np.full(len(adj.names), -1, np.int64)
        for stamp, (seed, nodes) in enumerate(_groups(batches)):
            goals = adj.numbers(nodes.cast(pa.string()))
            start = adj.numbers(pa.array([seed], pa.string()))
            goals = goals[goals >= 0]
            if len(goals):
                for _ in _search(adj, start, 0, mark, stamp, goals):
                    pass
                met = goals[mark[goals] == stamp]
                if len(met):
                    yield pa.RecordBatch.from_arrays([pa.array([seed] * len(met), pa.string()), adj.names.take(pa.array(met))], names=["seed", "node"])

    return _by_seed(wanted, "node").mapInArrow(run, "seed string, node string")


def extremes(pairs: DataFrame, seeds: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(node, low, high): the least and the greatest seed that reach each node. Every node is met once from below and once from above."""
    sent = pairs.sparkSession.sparkContext.broadcast(load(pairs, blocked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adj: Adjacency = sent.value
        parts = [x.column(0) for x in batches if x.num_rows]
        at = adj.numbers(pa.concat_arrays(parts)) if parts else np.empty(0, np.int64)
        at = np.unique(at[at >= 0])
        found = []
        for order in (at, at[::-1]):
            who = np.full(len(adj.names), -1, np.int64)
            for s in order:
                front = np.array([s])
                while len(front):
                    new = adj.after(front)
                    new = np.unique(new[who[new] < 0])
                    who[new] = s
                    front = new[~adj.stop[new]]
            found.append(who)
        hit = np.flatnonzero(found[0] >= 0)
        yield pa.RecordBatch.from_arrays([adj.names.take(pa.array(hit)), *[adj.names.take(pa.array(w[hit])) for w in found]], names=["node", "low", "high"])

    return seeds.select("seed").distinct().coalesce(1).mapInArrow(run, "node string, low string, high string")


def paths(pairs: DataFrame, ends: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(from, to, way): names of a shortest path from the first step on, least in byte order among equals.

    Targets are followed in byte order and first come, first kept, so the
    first way that meets a node is the least of the shortest ones.
    """
    sent = pairs.sparkSession.sparkContext.broadcast(load(pairs, blocked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adj: Adjacency = sent.value
        mark, before = np.full(len(adj.names), -1, np.int64), np.zeros(len(adj.names), np.int64)
        for stamp, (seed, nodes) in enumerate(_groups(batches)):
            goals = adj.numbers(nodes.cast(pa.string()))
            goals = goals[goals >= 0]
            front = adj.numbers(pa.array([seed], pa.string()))
            front = front[front >= 0]
            while len(front) and len(goals) and (mark[goals] != stamp).any():
                n = adj.first[front + 1] - adj.first[front]
                new, by = adj.after(front), np.repeat(front, n)
                fresh = mark[new] != stamp
                new, by = new[fresh], by[fresh]
                _, at = np.unique(new, return_index=True)
                at.sort()
                new, by = new[at], by[at]
                mark[new], before[new] = stamp, by
                front = new[~adj.stop[new]]
            met = [int(g) for g in goals if mark[g] == stamp]
            if not met:
                continue
            start = int(adj.numbers(pa.array([seed], pa.string()))[0])
            ways = []
            for g in met:
                way = [g]
                while before[way[-1]] != start:
                    way.append(int(before[way[-1]]))
                ways.append(way[::-1])
            sizes = np.cumsum([0, *map(len, ways)]).astype(np.int32)
            flat = adj.names.take(pa.array([x for w in ways for x in w], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([seed] * len(met), pa.string()), adj.names.take(pa.array(met, pa.int64())), pa.ListArray.from_arrays(pa.array(sizes), flat)], names=["from", "to", "way"])

    return _by_seed(ends.select(F.col("from").alias("seed"), F.col("to").alias("node")), "node").mapInArrow(run, "`from` string, `to` string, way array<string>")


def paths_in_pieces(e: DataFrame, ends: DataFrame, bins: DataFrame, blocked: DataFrame | None = None, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """(from, to, via) as ``graph.paths`` gives it, for the starts that lie in ``bins``; ``e`` is (source, resolved, ty), a written table.

    A bin's pairs are sent to each task that shares its starts; nodes that lead
    to no target of the bin are left out first.
    """
    step = pa.struct([("name", pa.string()), ("dependencyTypes", pa.list_(pa.string()))])
    kind = pa.schema([("from", pa.string()), ("to", pa.string()), ("via", pa.list_(step))])
    e = binned(e.select("source", "resolved", F.coalesce("ty", F.array().cast("array<string>")).alias("ty"), (wanted(F.col("resolved")) if wanted else F.lit(False)).alias("want")), bins, "source")
    ends = binned(ends.select("from", "to").distinct(), bins, "from")
    size = e.groupBy("bin", "piece").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("want"), F.col("resolved"))).alias("w"))
    starts = ends.groupBy("piece").agg(F.count_distinct("from").alias("s"), F.count("to").alias("g"))
    work = size.join(starts, "piece").groupBy("bin").agg(F.sum("s").alias("s"), F.ceil(F.sum(F.col("n") * F.col("s")) / BIN_WORK).alias("a"), F.ceil(F.sum(F.col("w") * F.col("s") + F.col("g")) / BIN_WAYS).alias("b"))
    shares = materialize(work.select("bin", F.least(F.greatest("a", "b", F.lit(1)), F.col("s")).cast("int").alias("shares")), "shares")
    left = e.join(F.broadcast(shares), "bin").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    if blocked is not None:
        left = left.join(blocked.select(F.col("node").alias("source")).distinct().withColumn("stop", F.lit(True)), "source", "left")
    else:
        left = left.withColumn("stop", F.lit(False))
    right = ends.join(F.broadcast(shares), "bin").withColumn("share", F.expr("pmod(hash(`from`), shares)"))

    def run(pairs: pa.Table, starts: pa.Table) -> pa.Table:
        if not pairs.num_rows or not starts.num_rows:
            return kind.empty_table()
        adj, by, order = _arrays(*(pairs.column(c).combine_chunks().cast(pa.string()) for c in ("source", "resolved")))
        flag = lambda c: pc.fill_null(pairs.column(c), False).combine_chunks().to_numpy(zero_copy_only=False)[order]
        adj.stop[by[flag("stop")]] = True
        every = np.unique(adj.to[flag("want")])
        a, b = (adj.numbers(starts.column(c).combine_chunks().cast(pa.string())) for c in ("from", "to"))
        open_ = starts.column("to").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        here = (a >= 0) & (open_ | (b >= 0))
        a, b, open_ = a[here], b[here], open_[here]
        kept = np.flatnonzero(_leading(adj, by, np.concatenate([b[~open_], every if open_.any() else every[:0]]))[adj.to])
        types = pairs.column("ty").combine_chunks().cast(pa.list_(pa.string())).take(pa.array(order[kept]))
        by = by[kept]
        adj = Adjacency(adj.names, np.searchsorted(by, np.arange(len(adj.names) + 1)), adj.to[kept], adj.stop)
        asked = [(s, np.array(list(at))) for s, at in groupby(np.argsort(a, kind="stable"), key=lambda i: a[i])]
        goals = [np.union1d(every[every != s] if open_[at].any() else every[:0], b[at][~open_[at]]) for s, at in asked]
        found = list(_ways(adj, by, [(s, x) for (s, _), x in zip(asked, goals)]))
        if not found:
            return kind.empty_table()
        froms, tos, sizes, flat = (np.concatenate(x) for x in zip(*found))
        name = lambda x: adj.names.take(pa.array(x))
        via = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.StructArray.from_arrays([name(adj.to[flat]), types.take(pa.array(flat))], fields=list(step)))
        return pa.Table.from_arrays([name(froms), name(tos), via], schema=kind)

    left = left.select(F.col("bin").alias("bin_l"), F.col("share").alias("share_l"), "source", "resolved", "ty", "want", "stop")
    right = right.select(F.col("bin").alias("bin_r"), F.col("share").alias("share_r"), "from", "to")
    return left.groupBy("bin_l", "share_l").cogroup(right.groupBy("bin_r", "share_r")).applyInArrow(lambda x, y: run(x, y), "`from` string, `to` string, via array<struct<name:string,dependencyTypes:array<string>>>")


def _leading(adj: Adjacency, by: np.ndarray, goals: np.ndarray) -> np.ndarray:
    """For each node, whether it is one of ``goals`` or one of them can be reached from it."""
    back = np.argsort(adj.to, kind="stable")
    turned = Adjacency(adj.names, np.searchsorted(adj.to[back], np.arange(len(adj.names) + 1)), by[back], np.zeros(len(adj.names), bool))
    mark = np.zeros(len(adj.names), np.int64)
    mark[goals] = 1
    for _ in _search(turned, goals, 0, mark, 1):
        pass
    return mark == 1


def _ways(adj: Adjacency, by: np.ndarray, asked: list[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    """(starts, goals met, steps of each way, pairs stepped over) for each (start, goals); ``by`` is the source of each pair.

    Shortest ways, least in byte order among equals, for the same reason as in ``paths``.
    """
    n = len(adj.names)
    mark, before, far = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for stamp, (start, goals) in enumerate(asked):
        front, level = np.array([start]), 0
        while len(front) and (mark[goals] != stamp).any():
            level += 1
            sizes = adj.first[front + 1] - adj.first[front]
            at = np.repeat(adj.first[front] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            at = at[mark[adj.to[at]] != stamp]
            at = at[np.sort(np.unique(adj.to[at], return_index=True)[1])]
            new = adj.to[at]
            mark[new], before[new], far[new] = stamp, at, level
            front = new[~adj.stop[new]]
        met = goals[mark[goals] == stamp]
        if not len(met):
            continue
        steps = far[met]
        flat = np.empty(steps.sum(), np.int64)
        node, to, left = met, np.cumsum(steps) - 1, steps
        while len(node):
            flat[to] = before[node]
            more = left > 1
            node, to, left = by[before[node]][more], to[more] - 1, left[more] - 1
        yield np.full(len(met), start), met, steps, flat


def _strong_names(src: pa.StringArray, dst: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
    """(node, scc) of pairs, as arrays."""
    names = pc.unique(pa.concat_arrays([src, dst]))
    names = names.take(pc.sort_indices(names))
    a, b = (pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (src, dst))
    of = strong(len(names), a, b)
    loops = np.zeros(len(names), bool)
    loops[a[a == b]] = True
    on = np.flatnonzero((np.bincount(of, minlength=len(names))[of] > 1) | loops)
    return names.take(pa.array(on)), names.take(pa.array(of[on]))


def components(pairs: DataFrame) -> DataFrame:
    """(node, scc) of nodes on cycles, ``scc`` the least name of the component; one task searches the whole graph, which ``fits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [x for x in batches if x.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([*_strong_names(*(pa.concat_arrays([x.column(i) for x in parts]).cast(pa.string()) for i in (0, 1)))], names=["node", "scc"])

    return pairs.select("src", "dst").coalesce(1).mapInArrow(run, "node string, scc string")


def components_in_pieces(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    """(node, scc) as ``components`` gives it, of the pairs whose source lies in ``bins``, a task for each bin."""

    def run(pairs: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([*_strong_names(*(pairs.column(c).combine_chunks().cast(pa.string()) for c in ("src", "dst")))], names=["node", "scc"])

    return binned(pairs, bins, "src").groupBy("bin").applyInArrow(lambda x: run(x), "node string, scc string")


def strong(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's strongly connected component; depth-first with a path stack, without recursion."""
    order = np.argsort(a, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]).tolist()
    to = b[order].tolist()
    least = np.arange(n)
    seen, at, done = [-1] * n, first[:-1], [False] * n
    clock = 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        way, open_, borders = [root], [root], [root]
        seen[root] = clock
        clock += 1
        while way:
            v = way[-1]
            i = at[v]
            if i < first[v + 1]:
                at[v] = i + 1
                w = to[i]
                if seen[w] < 0:
                    seen[w] = clock
                    clock += 1
                    way.append(w)
                    open_.append(w)
                    borders.append(w)
                elif not done[w]:  # an edge back joins all components on the way to it
                    while seen[borders[-1]] > seen[w]:
                        borders.pop()
                continue
            way.pop()
            if borders[-1] == v:
                borders.pop()
                part = []
                while True:
                    w = open_.pop()
                    done[w] = True
                    part.append(w)
                    if w == v:
                        break
                if len(part) > 1:
                    least[part] = min(part)
    return least
