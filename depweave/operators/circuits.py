"""First cycles in edge order as numbers: how many steps they have and which set of names they go through, without their names.

Rules about cycles ask whether some or all steps are of a kind, and findings
are told apart by the set of names on the cycle. Neither needs the steps
themselves, which are hundreds for an edge of a large component.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.operators.graph import EDGES_A_TASK, Graph, first_cycle
from depweave.session import materialize, parallelism

#: Partitions of the search for each that the session asks for: components differ much in cost.
TASKS = 4


def walk(es: list[list[int]], root: int) -> tuple[list[int], list[int]]:
    """Depth-first in the order of the targets: the nodes as they are come to, and for each the place at which what lies below it ends.

    All nodes must be reached from ``root``.
    """
    n = len(es)
    tried = bytearray(n)
    tried[root] = 1
    order, end, at = [root], [0], 0
    stack: list[Iterator[int]] = []
    places: list[int] = []
    rest = iter(es[root])
    while len(order) < n:
        for w in rest:
            if tried[w]:
                continue
            tried[w] = 1
            stack.append(rest)
            places.append(at)
            at = len(order)
            order.append(w)
            end.append(0)
            rest = iter(es[w])
            break
        else:
            end[at] = len(order)
            rest, at = stack.pop(), places.pop()
    for i in (at, *places):
        end[i] = n
    return order, end


def later(es: list[list[int]], more: list[int], watch: set[int], tried: bytearray, halted: set[int], source: int, target: int) -> tuple[int, list[int]] | None:
    """The way from ``target`` to ``source`` once one through a second visit of ``target`` was dropped: over ``more``, its further targets, and the place in these.

    ``tried`` marks the nodes come to so far, ``halted`` are those of them whose
    targets were not all tried; ``watch`` are the nodes with an edge to the source.
    """
    for at, c in enumerate(more):
        if tried[c] and c not in halted:
            continue
        tried[c] = 1
        if c in watch:
            return at, [target, c, source]
        way, stack = [c], [iter(es[c])]
        while stack:
            for w in stack[-1]:
                if tried[w]:
                    continue
                tried[w] = 1
                way.append(w)
                if w in watch:
                    return at, [target, *way, source]
                stack.append(iter(es[w]))
                break
            else:
                stack.pop()
                way.pop()
    return None


def first_ways(n: int, source: np.ndarray, target: np.ndarray, node: np.ndarray, step: np.ndarray, mine: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each edge of a strongly connected component the number of steps of its first cycle (0: none), and sums over the cycle.

    The edges come by source and in their order; ``node`` has numbers of each
    node, ``step`` of each edge, which are summed over the nodes and steps of a
    cycle. The rule is ``graph.first_cycle``'s. From a target its search goes to
    the target's first target and from there through the whole component, as if
    it had begun there, so one walk serves all targets that begin with the same
    one; a way to a source ends with the first node of the walk that has an edge
    to it. Only what a walk meets below the target itself, which the rule drops,
    is looked for on its own. ``mine`` limits the walks to some first targets.
    """
    # the first of the edges between two nodes stands for all
    _, rows, of = np.unique(source * n + target, return_index=True, return_inverse=True)
    order = np.argsort(rows)
    of, of_pair = np.argsort(order)[of], rows[order]
    src, dst, step, each = source[of_pair], target[of_pair], step[of_pair], step
    p = len(src)
    every = lambda a, b: [b[i:j].tolist() for i, j in zip(*(x.tolist() for x in (np.searchsorted(a, np.arange(n)), np.searchsorted(a, np.arange(n), "right"))))]
    es = every(src, dst)
    # a repeated target is come to again where a way was dropped, over its own edge
    full = es if p == len(source) else every(source, target)
    row = np.searchsorted(source, np.arange(n))
    first = np.searchsorted(src, np.arange(n + 1))
    by = np.argsort(dst, kind="stable")
    into, from_ = np.searchsorted(dst[by], np.arange(n + 1)), src[by]
    code = src * n + dst
    rank = np.argsort(code)
    code = code[rank]
    pair = lambda a, b: rank[np.searchsorted(code, a * n + b)]
    begin = dst[first[:-1]]
    own = np.ones(p, bool) if mine is None else mine[begin[dst]]
    steps, nodes, hits = np.zeros(p, np.int64), np.zeros((p, node.shape[1]), node.dtype), np.zeros((p, step.shape[1]), step.dtype)
    # the target's own targets are seen first
    back = np.minimum(np.searchsorted(code, dst * n + src), p - 1)
    direct = code[back] == dst * n + src
    i = np.flatnonzero(own & direct)
    other = i[src[i] != dst[i]]
    steps[i], nodes[i], hits[i] = 1, node[dst[i]], step[i]
    steps[other] += 1
    nodes[other] += node[src[other]]
    hits[other] += step[rank[back[other]]]
    loop = np.zeros(n, bool)
    loop[src[src == dst]] = True
    todo = np.flatnonzero(own & ~direct)
    todo = todo[np.argsort(begin[dst[todo]], kind="stable")]
    cuts = np.flatnonzero(np.diff(begin[dst[todo]])) + 1
    varied = bool(step.any())
    before: dict[int, list[tuple[int, list]]] = {}
    place = np.empty(n, np.int64)
    for i in np.split(todo, cuts) if len(todo) else ():
        start = int(begin[dst[i[0]]])
        order, end = walk(es, start)
        met, end = np.array(order), np.array(end)
        place[met] = np.arange(n)
        s, t = src[i], dst[i]
        v = np.minimum.reduceat(place[from_], into[:-1])[s]
        # a node's way are the nodes come to up to it without those that were left before
        left = np.cumsum(np.bincount(end, minlength=n + 1))[:n]
        leave = np.argsort(end * n + (n - 1 - np.arange(n)))
        sums = lambda w: (c := np.cumsum(w, 0)) - np.concatenate([np.zeros((1, w.shape[1]), w.dtype), np.cumsum(w[leave], 0)])[left]
        again = (place[t] <= v) & (v < end[place[t]])
        j, vj, sj, tj = i[~again], v[~again], s[~again], t[~again]
        steps[j] = vj + 1 - left[vj] + 2
        nodes[j] = sums(node[met])[vj] + node[sj] + node[tj]
        if varied:
            up = np.zeros(n, np.int64)
            for x, e in enumerate(end.tolist()):  # a later one lies nearer
                up[x + 1 : e] = x
            w = np.zeros((n, step.shape[1]), step.dtype)
            w[1:] = step[pair(met[up[1:]], met[1:])]
            hits[j] = step[j] + step[pair(tj, np.full(len(tj), start))] + sums(w)[vj] + step[pair(met[vj], sj)]
        a = np.flatnonzero(again)
        held, base, halted = -1, bytearray(), set()
        for x in a[np.argsort(v[a], kind="stable")].tolist():
            here, s_, t_ = int(v[x]), int(s[x]), int(t[x])
            watch, more = from_[into[s_] : into[s_ + 1]].tolist(), full[t_][1:]
            if loop[t_]:
                before = before or {k: [(w, row[k] + r) for r, w in enumerate(ws)] for k, ws in enumerate(full)}
                way, over = tuple(zip(*first_cycle(before, s_, t_, of_pair[i[x]]))) or ((), ())
            else:
                if len(watch) == 1:  # nothing else leads to the source
                    found = (more.index(watch[0]), [t_, watch[0], s_]) if watch[0] in more else None
                else:
                    if here != held:
                        held, base = here, bytearray(n)
                        for k in order[: here + 1]:
                            base[k] = 1
                        halted = set(met[: here + 1][end[: here + 1] > here].tolist())
                    found = later(es, more, set(watch), base[:], halted, s_, t_)
                if found is None:
                    continue
                way = np.array(found[1])
                over = of_pair[pair(np.concatenate([[s_], way[:-1]]), way)]
                over[1] = row[t_] + 1 + found[0]
            if len(way):
                steps[i[x]], nodes[i[x]], hits[i[x]] = len(way), node[np.array(way)].sum(0), each[np.array(over)].sum(0)
    return steps[of], nodes[of], hits[of]


def counted_cycles(g: Graph, scc: DataFrame, asks: list[Column], edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """The edges on cycles, with ``steps``, ``key`` (of the set of names) and ``hits`` of their first cycles and the ``kind_`` of the first edge between the same two.

    ``asks`` are predicates of a step over ``step`` (name, dependencyTypes);
    ``hits`` says for each how many steps of the cycle fulfil it. The cycle is
    the one that ``graph.cycles`` gives.
    """
    e = g.edges.drop("circular", "cycle")
    inside = e.join(scc.select(F.col("node").alias("source"), "scc"), "source").join(scc.select(F.col("node").alias("resolved"), F.col("scc").alias("scc2")), "resolved").where("scc = scc2").drop("scc2")
    inside = inside.withColumn("step", F.struct(F.col("resolved").alias("name"), F.coalesce("dependencyTypes", F.array().cast("array<string>")).alias("dependencyTypes")))
    inside = materialize(inside.withColumn("asked", F.array(*[F.coalesce(a, F.lit(False)).cast("int") for a in asks]).cast("array<int>")).drop("step"), "cyclic")
    size = inside.groupBy("scc").agg(F.ceil(F.count(F.lit(1)) / edges_a_task).cast("int").alias("shares"))
    large = materialize(size.where("shares > 1"), "shares")
    sent = inside.join(F.broadcast(large), "scc", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    sent = sent.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    columns = [c for c in inside.columns if c not in ("scc", "asked")]
    kinds = len(asks)

    def search(t: pa.Table) -> pa.RecordBatch:
        share, shares = t.column("share")[0].as_py(), t.column("shares")[0].as_py()
        source, resolved = (t.column(c).combine_chunks().cast(pa.string()) for c in ("source", "resolved"))
        names = pc.unique(pa.concat_arrays([source, resolved]))
        names = names.take(pc.sort_indices(names))
        n = len(names)
        a, b = (pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64) for x in (source, resolved))
        texts = [x.encode("utf-8", "surrogatepass") for x in names.to_pylist()]
        node = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in texts), np.uint64).reshape(n, 2)
        step = t.column("asked").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(a), kinds)
        # a kind that no step or every one is of needs no sum
        all_ = step.all(0)
        mine = None if shares == 1 else np.array([zlib.crc32(x) % shares == share for x in texts])
        steps, nodes, hits = first_ways(n, a, b, node, np.where(all_, 0, step), mine)
        hits = np.where(all_, steps[:, None], hits)
        out = np.flatnonzero((steps > 0) & t.column("ord").combine_chunks().is_valid().to_numpy(zero_copy_only=False))
        told = t.take(pa.array(out))
        key = pa.Array.from_buffers(pa.binary(16), len(out), [None, pa.py_buffer(np.ascontiguousarray(nodes[out]).tobytes())]).cast(pa.binary())
        hit = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * kinds), pa.array(hits[out].ravel().astype(np.int32)))
        _, rows, of = np.unique(a * n + b, return_index=True, return_inverse=True)
        kind = t.column("dependencyKind").take(pa.array(rows[of[out]]))
        more = [pa.array(steps[out].astype(np.int32)), key, hit, kind]
        return pa.Table.from_arrays([*[told.column(c) for c in columns], *more], names=[*columns, "steps", "key", "hits", "kind_"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        mark = None
        for x in batches:
            if not x.num_rows:
                continue
            t = pa.Table.from_batches([x])
            scc, share = t.column("scc").combine_chunks(), t.column("share").combine_chunks()
            change = pc.or_(pc.not_equal(scc[1:], scc[:-1]), pc.not_equal(share[1:], share[:-1])).to_numpy(zero_copy_only=False)
            at = [0, *(np.flatnonzero(change) + 1).tolist(), t.num_rows]
            for i, j in zip(at, at[1:]):
                if held and mark != (scc[i], share[i]):
                    yield from search(pa.concat_tables(held)).to_batches()
                    held = []
                mark = (scc[i], share[i])
                held.append(t.slice(i, j - i))
        if held:
            yield from search(pa.concat_tables(held)).to_batches()

    kind = {f.name: f.dataType.simpleString() for f in sent.schema.fields}
    schema = ", ".join([*[f"`{c}` {kind[c]}" for c in columns], "steps int", "key binary", "hits array<int>", "kind_ string"])
    parted = sent.repartition(TASKS * parallelism(sent.sparkSession), "scc", "share").sortWithinPartitions("scc", "share", "source", F.asc_nulls_last("ord"))
    return parted.mapInArrow(run, schema)
