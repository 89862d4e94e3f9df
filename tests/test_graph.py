"""Graph derivations on literal graphs and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from depweave.operators.filters import collapse_pattern, consolidate, do_not_follow, exclude, focus, highlight, include_only, max_depth, reaches
from depweave.operators import local
from depweave.operators.graph import Graph, can_reach, components, cycles, dependents, extremes, first_cycle, first_cycles, first_path, mark_circular, meets, orphans, paths, reach, same_component
from depweave.operators.metrics import couplings, folder_edges, folder_table, project_table, sinks, totals, with_metrics


def graph(spark, edges, modules=None):
    seen = {}
    rows = []
    for a, b in edges:
        rows.append((a, seen.setdefault(a, 0), b, ["local"]))
        seen[a] += 1
    e = spark.createDataFrame(rows, "source string, ord long, resolved string, dependencyTypes array<string>")
    m = None
    if modules is not None:
        m = spark.createDataFrame([(s, i) for i, s in enumerate(modules)], "source string, ord long")
    return Graph.of(e, m)


SMALL = [("a", "b"), ("a", "x"), ("b", "c"), ("c", "a"), ("x", "y"), ("self", "self")]
REVISIT = [("a", "b"), ("b", "c"), ("b", "d"), ("c", "b"), ("d", "a")]
EMPTY = [("a", "b"), ("b", "c"), ("b", "d"), ("c", "b"), ("d", "e"), ("e", "a")]


def adjacency(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append((b, []))
    return out


@pytest.mark.parametrize(
    ("edges", "edge", "want"),
    [(SMALL, ("a", "b"), ["b", "c", "a"]), (SMALL, ("self", "self"), ["self"]), (REVISIT, ("a", "b"), ["b", "d", "a"]), (EMPTY, ("a", "b"), []), ([("a", "b"), ("b", "a")], ("a", "b"), ["b", "a"])],
)
def test_first_cycle(edges, edge, want):
    assert [n for n, _ in first_cycle(adjacency(edges), *edge, [])] == want


def test_first_cycle_is_deep_safe():
    n = 5000
    edges = [(str(i), str(i + 1)) for i in range(n)] + [(str(n), "0")]
    assert len(first_cycle(adjacency(edges), "0", "1", [])) == n + 1


def test_a_node_is_come_to_once_in_a_search():
    # complete graph: every node is a target of all others, searched again and again if it were come to by each
    from depweave.operators import graph as gr

    n = 30
    adj = adjacency([(f"n{i:02}", f"n{(i + k) % n:02}") for i in range(n) for k in range(1, n)])

    class Counted(dict):
        asked = 0

        def get(self, *x):
            Counted.asked += 1
            return super().get(*x)

    first_cycles(Counted(adj), "n00", {"n01": [], "zz": []}, Counted(gr.first_types(adj)))
    assert Counted.asked <= n + 1


def test_searches_shared_by_target_give_the_same():
    rng = random.Random(7)
    seen = {"alone": 0}
    for _ in range(400):
        n = rng.randrange(2, 12)
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.randrange(1, 30))]
        adj = {}
        for i, (a, b) in enumerate(edges):
            adj.setdefault(a, []).append((b, [str(i)]))
        for t in {b for _, b in edges}:
            initials = {}
            for a, b in edges:
                if b == t:
                    initials.setdefault(a, next(ty for x, ty in adj[a] if x == t))
            got = first_cycles(adj, t, initials)
            for a, ty in initials.items():
                assert got.get(a, []) == first_cycle(adj, a, t, ty), (edges, a, t)
                seen["alone"] += 1
    assert seen["alone"] > 1000


def test_counted_ways_are_those_of_the_first_cycles():
    import numpy as np

    from depweave.operators import circuits, local

    rng = random.Random(11)
    told, dropped = 0, 0
    for _ in range(500):
        n = rng.randrange(1, 13)
        edges = sorted([(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 40))], key=lambda e: e[0])
        of = local.strong(n, *np.array(edges).T)
        for c in set(of.tolist()):
            inside = [(a, b) for a, b in edges if of[a] == c == of[b]]
            number = {x: i for i, x in enumerate(sorted({x for e in inside for x in e}))}
            adj = {}
            for i, (a, b) in enumerate(inside):
                adj.setdefault(number[a], []).append((number[b], i))
            if not inside:
                continue
            a, b = (np.array([number[e[k]] for e in inside]) for k in (0, 1))
            step = np.array([[rng.randrange(1000), rng.randrange(2)] for _ in inside])
            node = 1 << np.arange(len(number), dtype=np.uint64)[:, None]
            shared = [circuits.first_ways(len(number), a, b, node, step, np.arange(len(number)) % 2 == k) for k in (0, 1)]
            whole = circuits.first_ways(len(number), a, b, node, step)
            assert all((x + y == z).all() for x, y, z in zip(*shared, whole))
            for s, t, n_, names, hits in zip(a.tolist(), b.tolist(), *whole):
                want = first_cycle(adj, s, t, next(i for x, i in adj[s] if x == t))
                assert n_ == len(want) and names[0] == sum(1 << x for x, _ in want) and hits.tolist() == [sum(step[i, k] for _, i in want) for k in (0, 1)], (inside, s, t)
                told, dropped = told + 1, dropped + (not want)
    assert told > 1000 and dropped > 50


def test_cycles_and_components(spark, rows):
    g = graph(spark, SMALL)
    scc = components(g.pairs)
    assert {(r["node"]) for r in scc.collect()} == {"a", "b", "c", "self"}
    assert len({r["scc"] for r in scc.collect()}) == 2
    got = {(r["source"], r["ord"]): [s["name"] for s in r["cycle"]] for r in cycles(g, scc).collect()}
    assert got == {("a", 0): ["b", "c", "a"], ("b", 0): ["c", "a", "b"], ("c", 0): ["a", "b", "c"], ("self", 0): ["self"]}
    big = {(r["source"], r["ord"]): [s["name"] for s in r["cycle"]] for r in cycles(g, scc, exact_edges=0).collect()}
    assert big == got
    marked = {(r["source"], r["resolved"]): r["circular"] for r in mark_circular(g).edges.collect()}
    assert marked == {e: e in {("a", "b"), ("b", "c"), ("c", "a"), ("self", "self")} for e in SMALL}
    assert mark_circular(graph(spark, EMPTY)).edges.where("circular").count() < mark_circular(graph(spark, EMPTY), exact=False).edges.where("circular").count()


def test_cycles_are_the_same_at_every_size(spark):
    # the first way back leads over c and e, a shortest one over d
    rest = [("b", 0, "c"), ("b", 1, "d"), ("c", 0, "e"), ("e", 0, "a"), ("d", 0, "a")]
    for n in (1, 200_001):
        e = spark.range(n).select(F.lit("a").alias("source"), F.col("id").alias("ord"), F.lit("b").alias("resolved")).unionByName(spark.createDataFrame(rest, "source string, ord long, resolved string"))
        got = cycles(Graph.of(e)).where("source = 'a'")
        assert [(r["names"], r["count"]) for r in got.groupBy(F.expr("transform(cycle, s -> s.name)").alias("names")).count().collect()] == [(["b", "c", "e", "a"], n)]


def test_cycles_do_not_depend_on_the_share_of_a_task(spark):
    rng = random.Random(5)
    g = graph(spark, sorted({(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(70)}))
    scc = components(g.pairs)
    told = lambda df: sorted((r["source"], r["ord"], [s["name"] for s in r["cycle"]]) for r in df.collect())
    assert told(cycles(g, scc)) == told(cycles(g, scc, edges_a_task=3)) != []


def _closure(edges):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    out = {}
    for s in adj:
        seen, todo = {}, [(b, 1) for b in sorted(adj[s])]
        while todo:
            n, d = todo.pop(0)
            if n not in seen:
                seen[n] = d
                todo += [(x, d + 1) for x in sorted(adj.get(n, ()))]
        out[s] = seen
    return out


def test_components_and_reach_against_brute_force(spark):
    rng = random.Random(1)
    edges = sorted({(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(95)})
    g, close = graph(spark, edges), _closure(edges)
    nodes = {x for e in edges for x in e}
    want = {(a, b) for a in nodes for b in nodes if a != b and b in close.get(a, ()) and a in close.get(b, ())}
    got = components(g.pairs).collect()
    label = {r["node"]: r["scc"] for r in got}
    assert {(a, b) for a in label for b in label if a != b and label[a] == label[b]} == want
    assert {a for a in nodes if a in close.get(a, ())} == set(label)
    seeds = spark.createDataFrame([("n1", "n1"), ("n2", "n2"), ("zz", "zz")], "seed string, node string")
    for depth in (0, 2):
        got = {(r["seed"], r["node"]): r["level"] for r in reach(g.pairs, seeds, depth).collect()}
        assert got == {(s, n): d for s in ("n1", "n2") for n, d in close.get(s, {}).items() if not depth or d <= depth}
    assert can_reach(g.pairs, "n1", "n2") == ("n2" in close.get("n1", ()))
    assert not can_reach(g.pairs, "n1", "nowhere")
    ends = spark.createDataFrame([("n1", n) for n in sorted(nodes)], "`from` string, `to` string")
    assert {r["to"]: len(r["via"]) for r in paths(g, ends).collect()} == close.get("n1", {})


@pytest.mark.parametrize("seed", [3])
def test_both_ways_of_searching_agree(spark, rows, monkeypatch, seed):
    rng = random.Random(seed)
    edges = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(50)})
    g, close = graph(spark, edges), _closure(edges)
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(0, 30, 4)] + [("zz",)], "seed string")
    starts = seeds.select("seed", F.col("seed").alias("node"))
    stop = spark.createDataFrame([("n0",), ("n5",), ("n9",), ("zz",)], "node string")
    ends = seeds.select(F.col("seed").alias("from")).crossJoin(spark.createDataFrame([(f"n{i}",) for i in range(30)], "`to` string"))
    wanted = ends.select(F.col("from").alias("seed"), F.col("to").alias("node"))
    told = []
    for pairs in (local.PAIRS, 0):
        monkeypatch.setattr(local, "PAIRS", pairs)
        told.append([
            rows(reach(g.pairs, starts), "seed", "node", "level"), rows(reach(g.pairs, starts, 2, stop), "seed", "node", "level"), rows(reach(g.pairs, starts, blocked=stop), "seed", "node", "level"),
            rows(meets(g.pairs, wanted), "seed", "node"), rows(meets(g.pairs, wanted, stop), "seed", "node"),
            rows(extremes(g.pairs, seeds), "node", "low", "high"), rows(extremes(g.pairs, seeds, stop), "node", "low", "high"),
            rows(paths(g, ends), "from", "to", "via"), rows(paths(g, ends, stop), "from", "to", "via"), rows(components(g.pairs), "node", "scc"),
        ])
    assert told[0] == told[1]
    assert told[0][3] == sorted((s, n) for s in close if int(s[1:]) % 4 == 0 for n in close[s])
    by = {n: sorted(s for s in close if int(s[1:]) % 4 == 0 and n in close[s]) for n in {b for _, b in edges}}
    assert told[0][5] == sorted((n, v[0], v[-1]) for n, v in by.items() if v)


def _fleet(seed):
    """Edges of four repositories with targets in common, two of which one way connects."""
    rng = random.Random(seed)
    edges = {(f"r{k}/n{rng.randrange(12)}", f"r{k}/n{rng.randrange(12)}") for k in range(4) for _ in range(22)}
    edges |= {(f"r{k}/n{rng.randrange(12)}", to) for k in range(4) for to in ("fs", "path", "r9/gone")}
    return sorted(edges | {("r0/n1", "r1/n2")})


@pytest.mark.parametrize("bound", [60, 30])
def test_a_graph_beyond_a_task_is_searched_piece_by_piece(spark, rows, monkeypatch, bound):
    from depweave.operators import graph as gr

    edges = _fleet(bound)
    g = graph(spark, edges)
    named = spark.createDataFrame([(a, b) for a in ("r0/n1", "r2/n3", "fs", "zz") for b in ("fs", "r1/n4", "r2/n3", "r2/n5", "r9/gone")], "`from` string, `to` string")
    open_ = spark.createDataFrame([(f"r{k}/n{i}", None) for k in range(4) for i in range(0, 12, 2)], "`from` string, `to` string")
    stop = spark.createDataFrame([("r0/n4",), ("r2/n6",), ("fs",)], "node string")
    wanted = lambda c: c.rlike("[1357]$|fs|gone")
    told = lambda: [rows(components(g.pairs), "node", "scc"), *[rows(paths(g, *x), "from", "to", "via") for x in ((open_, None, wanted), (named, stop))[: bound // 30]]]
    want = told()
    close = _closure(edges)
    assert [(a, b, len(v)) for a, b, v in want[1]] == sorted((a, b, d) for a in close if a[-1] in "02468" for b, d in close[a].items() if b != a and (b[-1] in "1357" or b in ("fs", "r9/gone")))
    monkeypatch.setattr(local, "PAIRS", bound)
    if bound == 60:  # every piece fits a task, so no round is needed
        for f in ("_reach", "_paths", "_components"):
            monkeypatch.setattr(gr, f, None)
        monkeypatch.setattr(local, "BIN_WAYS", 5)
        monkeypatch.setattr(local, "BIN_PAIRS", 1)
    assert told() == want


def test_rounds_leave_no_tables(spark, monkeypatch):
    from depweave import session

    monkeypatch.setattr(local, "PAIRS", 0)
    g = graph(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n6", "n0")])
    before = len(session._written)
    components(g.pairs)
    assert len(session._written) - before == 2  # the pairs and the result


def test_reach_is_blocked_but_reached(spark, rows):
    g = graph(spark, [("a", "b"), ("b", "c"), ("a", "a")])
    got = reach(g.pairs, spark.createDataFrame([("a", "a")], "seed string, node string"), blocked=spark.createDataFrame([("b",), ("a",)], "node string"))
    assert rows(got, "node") == [("a",), ("b",)]
    assert [n for n, _ in first_path(adjacency([("a", "b"), ("b", "c"), ("a", "c")]), "a", "c")] == ["b", "c"]
    assert first_path(adjacency([("a", "b"), ("b", "c")]), "a", "c", {"b"}) == []


def test_empty_graph(spark):
    g = graph(spark, [], [])
    assert components(g.pairs).count() == 0 and cycles(g).count() == 0 and orphans(g).count() == 0
    assert totals(g).first().asDict() == {"totalCruised": 0, "totalDependenciesCruised": 0}
    assert paths(g, spark.createDataFrame([("a", "b")], "`from` string, `to` string")).count() == 0


def test_dependents_orphans(spark, rows):
    g = graph(spark, [*SMALL, ("b", "c")], ["a", "b", "c", "x", "y", "self", "lone"])
    assert rows(dependents(g)) == [("a", ["c"]), ("b", ["a"]), ("c", ["b"]), ("self", ["self"]), ("x", ["a"]), ("y", ["x"])]
    assert rows(orphans(g)) == [("lone",)]
    scc = components(g.pairs)
    ends = spark.createDataFrame([("a", "b"), ("a", "x"), ("y", "y")], "a string, b string")
    assert rows(same_component(scc, ends)) == [("a", "b", True), ("a", "x", False), ("y", "y", True)]


def test_metrics(spark, rows):
    g = graph(spark, [("s/a", "s/b"), ("s/a", "t/c"), ("s/a", "t/c"), ("t/c", "u"), ("u", "s/b")], ["s/a", "s/b", "t/c", "u"])
    assert rows(couplings(g)) == [("s/a", 3, 0, 1.0), ("s/b", 0, 2, 0.0), ("t/c", 1, 1, 0.5), ("u", 1, 1, 0.5)]
    assert {(r["source"], r["resolved"]): r["instability"] for r in with_metrics(g).edges.collect()}[("s/a", "t/c")] == 0.5
    f = folder_table(g)
    got = {r["name"]: (r["moduleCount"], r["afferentCouplings"], r["efferentCouplings"]) for r in f.collect()}
    # the root folder is "." and nothing lies below "./", so all its couplings leave it
    assert got == {"s": (2, 1, 2), "t": (1, 1, 1), ".": (1, 1, 1)}
    e = folder_edges(g, f)
    assert rows(e, "name", "to") == [(".", "s"), ("s", "t"), ("t", "u")]
    assert rows(sinks(f, e), "name", "moduleCount") == [("u", -1)]
    m = g.modules.withColumn("project", F.when(F.col("source") != "u", F.substring("source", 1, 1)))
    t, pe = project_table(g.with_(modules=m))
    assert rows(pe, "name", "to") == [("s", "t"), ("t", "u")]
    assert {r["name"]: (r["moduleCount"], r["afferentCouplings"], r["efferentCouplings"]) for r in t.collect()} == {"s": (2, 1, 2), "t": (1, 1, 1)}


FILTERS = [("src/main.ts", "src/a.ts"), ("src/main.ts", "node_modules/x"), ("src/a.ts", "src/b.ts")]


def test_filters(spark, rows):
    g = graph(spark, FILTERS, ["src/main.ts", "src/a.ts", "src/b.ts", "node_modules/x"])
    e = lambda x: rows(x.edges, "source", "resolved")
    m = lambda x: {r["source"] for r in x.modules.collect()}
    assert e(exclude(g, "node_modules")) == [("src/a.ts", "src/b.ts"), ("src/main.ts", "src/a.ts")]
    assert m(include_only(g, "^src/[ab]")) == {"src/a.ts", "src/b.ts"} and e(include_only(g, "^src/[ab]")) == [("src/a.ts", "src/b.ts")]
    f = focus(g, "^src/a")
    assert m(f) == {"src/main.ts", "src/a.ts", "src/b.ts"} and rows(f.modules.where("matchesFocus"), "source") == [("src/a.ts",)]
    assert m(focus(g, "main", 1)) == {"src/main.ts", "src/a.ts", "node_modules/x"} and len(m(focus(g, "main", 0))) == 4
    assert m(reaches(g, "^src/b")) == {"src/main.ts", "src/a.ts", "src/b.ts"} and m(reaches(g, "^src/b", 1)) == {"src/a.ts", "src/b.ts"}
    assert highlight(g, "").modules.where("matchesHighlight").count() == 4
    assert m(max_depth(g, "main", 1)) == {"src/main.ts", "src/a.ts", "node_modules/x"}
    assert e(do_not_follow(g, "^src/a")) == [("src/main.ts", "node_modules/x"), ("src/main.ts", "src/a.ts")]


def test_consolidate(spark, rows):
    e = spark.createDataFrame(
        [("a/x", 0, "b/y", ["npm"], True), ("a/x", 1, "a/z", ["local"], True), ("a/z", 0, "b/q", ["local"], False)], "source string, ord long, resolved string, dependencyTypes array<string>, valid boolean"
    )
    m = spark.createDataFrame([("a/x", 0, True, None), ("a/z", 1, False, "python"), ("b/y", 2, None, "dotnet"), ("b/q", 3, True, None)], "source string, ord long, valid boolean, language string")
    c = consolidate(Graph.of(e, m))
    # the first edge wins; its types and validity stay
    assert rows(c.edges, "source", "ord", "resolved", "dependencyTypes", "valid") == [("a", 0, "b", ["npm"], True), ("a", 1, "a", ["local"], True)]
    assert rows(c.modules, "source", "valid", "language") == [("a", False, "python"), ("b", True, "dotnet")]
    assert rows(consolidate(Graph.of(e, m), pattern="^a", drop_self=True).edges, "source", "resolved") == [("a", "b/q"), ("a", "b/y")]
    assert collapse_pattern("2") == "node_modules/[^/]+|^[^/]+/[^/]+/" and collapse_pattern("^x") == "^x"
