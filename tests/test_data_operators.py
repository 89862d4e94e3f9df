"""Operators of the general data problems against brute force and on odd input."""

import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from depweave.functions.paths import dirname, name_set, normalize_dots, parents, path_form
from depweave.operators import field61 as gf
from depweave.operators.reconcile import Field, interpolate, reconcile, _points
from depweave.operators.shred import MODULES, adjacency, decode, document_edges, graph_tables, rebuild, shred
from depweave.operators.skew import distinct_counts, key_loads, pack, plan, skew_join
from depweave.operators.snapshots import snapshot_changes


def test_path_form(spark, rows):
    given = [" ./a//b ", ".\\A\\b.cs", "a/b", None, "", "././x", "\ta/b\n", ".//x", "../y"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(given)], "i int, p string")
    got = [r[0] for r in df.orderBy("i").select(path_form(F.col("p"))).collect()]
    assert got == ["a/b", "A/b.cs", "a/b", None, "", "x", "a/b", "x", "../y"]


def test_dirname_parents_dots(spark):
    df = spark.createDataFrame([("a/b/c",), ("a",), ("/a",), ("a/b/",), ("/a/b",), ("/",), (None,)], "p string")
    assert [r[0] for r in df.select(dirname(F.col("p"))).collect()] == ["a/b", ".", "/", "a", "/a", "/", None]
    df = spark.createDataFrame([("a/./b/../c",), ("../a",), ("a/../../b",)], "p string")
    assert [r[0] for r in df.select(normalize_dots(F.col("p"))).collect()] == ["a/c", "../a", "../b"]
    assert spark.range(1).select(parents(F.lit("a/b/c"))).first()[0] == ["a", "a/b", "a/b/c"]


def test_plan_splits_hot_keys(spark):
    df = spark.range(10000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    p = plan(key_loads(df, ["k"]), ["k"], "load_", 8)
    assert set(p.shards) == {("hot",)} and len(set(p.shards[("hot",)])) >= 4
    assert max(p.planned) < 1.3 * 10000 / 8
    at, loads = pack([(5, "a"), (4, "b"), (3, "c"), (3, "d")], 2)
    assert sorted(loads) == [7, 8]


def test_distinct_counts_brute_force(spark, rows):
    rng = random.Random(3)
    data = []
    for i in range(3000):
        key = rng.choice(["hot"] * 8 + ["a", "b", None, *map(str, range(40))])
        items = rng.choice([None, [], ["x"], ["x", "x", None], ["y", "x"], [None]])
        data += [(key, i, items, "extra")] * rng.choice([1, 1, 1, 3])
    df = spark.createDataFrame(data, "k string, id int, t array<string>, item string")
    want = Counter()
    for key, i, items, _ in set((k, i, tuple(t) if t is not None else None, e) for k, i, t, e in data):
        for x in {None, *(items or ())}:
            want[(key, x)] += 1
    got = {(r["k"], r["item"]): r["n"] for r in distinct_counts(df, ["k"], ["id"], "t", 4).collect()}
    assert got == dict(want)


def test_skew_operators_on_empty_tables(spark, rows):
    df = spark.createDataFrame([], "k string, id int, t array<string>")
    assert distinct_counts(df, ["k"], ["id"], "t").count() == 0
    assert skew_join(df, df.select("k", "id"), ["k"], ["id"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_is_a_join(spark, rows, how):
    big = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 97).cast("string")).alias("k"), "id", F.lit(1).alias("v"))
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("5", 3), (None, 4), ("none", 5)], "k string, v int")
    got = skew_join(big, small, ["k"], ["id"], 4, how)
    want = big.join(small.withColumnRenamed("v", "v_"), "k", how)
    assert rows(got, "k", "id", "v", "v_") == rows(want, "k", "id", "v", "v_")
    # both sides meet in the placed partitions: one exchange each and no more
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 0


def _named(body):
    """Plain recursion over the decoded document, as a check of the shredding."""
    doc = decode(body)
    lst = lambda x: x if isinstance(x, list) else [] if x is None else [x]
    mods = doc if isinstance(doc, list) else (doc or {}).get("modules", (doc or {}).get("graph", {}).get("modules")) if doc else None
    out = []
    for mi, m in enumerate(lst(mods)):
        if not isinstance(m, dict):
            continue
        if m.get("source"):
            out.append(("module", mi, -1, -1, m["source"]))
        for di, d in enumerate(lst(m.get("dependencies"))):
            if not isinstance(d, dict):
                continue
            if d.get("resolved"):
                out.append(("dependency", mi, di, -1, d["resolved"]))
            for kind, key in (("rule", "rules"), ("cycle", "cycle")):
                for ii, x in enumerate(lst(d.get(key))):
                    name = x if isinstance(x, str) else x.get("name") if isinstance(x, dict) else None
                    if name:
                        out.append((kind, mi, di, ii, name))
    return out


BODIES = [
    '{"modules":[{"source":"a","dependencies":[{"resolved":"b","rules":[{"name":"r"},null,"s"],"cycle":{"name":"c"},"x":{"rules":[{"name":"no"}]}},null]},null,{"source":null,"dependencies":{"resolved":"d","rules":"t"}}]}',
    '{"graph":{"modules":{"source":"\\u00e9\\n","rules":[{"name":"own"}]}},"version":3}',
    '[{"source":"q","dependencies":[{"rules":[],"cycle":null,"resolved":""}]}]',
    "", None, "{", "null", "3", '"x"', "[]", "{}", '{"modules":null}', '{"modules":[1,true,[{"source":"in"}]]}',
    '{"modules":[{"source":"\\ud800x"}]}', '\ufeff{"modules":[{"source":"bom"}]}', '{"modules":[{"source":NaN}]}', "[" * 100000,
]


def _json(rng, depth):
    """A random document."""
    kind = rng.randrange(9 if depth else 6)
    if kind < 6:
        return rng.choice(["", "x", "é", None, True, False, 0, -3, 1.5, 10**20, "modules"])
    if kind < 8:
        return {rng.choice(["", "source", "modules", "dependencies", "a", "b", "rules"]): _json(rng, depth - 1) for _ in range(rng.randrange(5))}
    return [_json(rng, depth - 1) for _ in range(rng.randrange(4))]


def test_adjacency_round_trip():
    rng = random.Random(12)
    docs = [_json(rng, 5) for _ in range(3000)] + [d for d in map(decode, BODIES) if d is not None]
    for doc in docs:
        rows = list(adjacency(doc, *MODULES).tuples())
        rng.shuffle(rows)
        assert rebuild(rows) == doc
        assert len({r[0] for r in rows}) == len(rows) and all(type(a) is type(b) for a, b in zip([rebuild(rows)], [doc]))


def test_every_field_is_stored(spark, rows):
    body = '{"v": 2, "g": {"modules": [{"source": "a", "x": [1.5, null, "t", []], "y": {"z": false}}]}}'
    df = spark.createDataFrame([(7, body)], "id long, body string")
    assert rows(shred(df, "id", "body"), "record", "label", "ordinal", "kind", "scalar") == sorted(
        [(7, "", None, "object", None), (7, "v", None, "number", "2"), (7, "g", None, "object", None), (7, "modules", 0, "object", None), (7, "source", None, "string", "a"), (7, "x", 0, "number", "1.5"), (7, "x", 1, "null", "null"),
         (7, "x", 2, "string", "t"), (7, "x", 3, "array", None), (7, "y", None, "object", None), (7, "z", None, "boolean", "false")], key=repr)


def test_shredding_against_recursion(spark, rows):
    big = json.dumps({"modules": [{"source": f"m{i}", "dependencies": [{"resolved": f"d{j}", "rules": [{"name": "r"}]} for j in range(20)]} for i in range(200)]})
    df = spark.createDataFrame(list(enumerate([*BODIES, big, big])), "record_id long, body string").withColumn("label", F.lit("x"))
    got = rows(graph_tables(df, "record_id", "body").named())
    want = []
    for i, b in enumerate([*BODIES, big, big]):
        try:
            want += [(i, *x) for x in _named(b)]
        except AttributeError:
            pass
    want = [(*w[:5], w[5].replace("\ud800", "�")) for w in want]
    assert got == sorted(want, key=repr)


def test_shredded_tables_keep_parents(spark, rows):
    t = graph_tables(spark.createDataFrame([(1, BODIES[0])], "record_id long, body string"), "record_id", "body")
    assert rows(t.dependencies, "module_source", "module_ord", "ordinal", "resolved") == [("a", 0, 0, "b"), (None, 2, 0, "d")]
    assert rows(t.rules, "dep_resolved", "ordinal", "name") == [("b", 0, "r"), ("b", 2, "s"), ("d", 0, "t")]


def _snapshots(data):
    held = {}
    for g, s, t, d, k, v in data:
        at = held.setdefault((g, s), {})
        if k not in at or (d, v is not None, v or 0) > at[k][0]:
            at[k] = ((d, v is not None, v or 0), v)
    when = {(g, s): t for g, s, t, *_ in data}
    out = []
    for g in {g for g, _ in held}:
        ids = sorted((s for gg, s in held if gg == g), key=lambda s: (when[(g, s)], s))
        for a, b in zip(ids, ids[1:]):
            x, y = held[(g, a)], held[(g, b)]
            out += [(b, k, "added") for k in y.keys() - x.keys()] + [(b, k, "removed") for k in x.keys() - y.keys()]
            out += [(b, k, "changed") for k in x.keys() & y.keys() if x[k][1] != y[k][1]]
    return sorted(out, key=repr)


def test_snapshot_changes_brute_force(spark, rows):
    rng = random.Random(8)
    data, sid = [], 0
    for g in ["p", "q", None]:
        state = {f"k{i}": rng.randrange(3) for i in range(400)}
        for t in range(4):
            sid += 1
            for k, v in state.items():
                data.append((g, 100 - sid, t, 1, k, v))
                if rng.random() < 0.05:
                    data.append((g, 100 - sid, t, rng.choice([0, 1, 2]), k, rng.choice([v, 7, None])))
            for _ in range(10):
                state.pop(rng.choice(sorted(state)))
                state[f"n{rng.randrange(10**6)}"] = 1
                state[rng.choice(sorted(state))] = None
    data.append((None, 50, 9, 1, None, 3))
    df = spark.createDataFrame(data, "g string, s long, t int, d int, k string, v int").withColumn("chunk", F.lit(0)).repartition(3)
    got = snapshot_changes(df, "g", "s", "t", F.col("k"), F.col("v"), ["d"])
    assert rows(got, "s", "key", "change") == _snapshots(data)
    assert snapshot_changes(df.limit(0), "g", "s", "t", F.col("k"), F.col("v"), ["d"]).count() == 0


def test_unchanged_chunks_are_discarded(spark):
    data = [("g", s, s, 1, f"k{i:05d}", 1 if i or s == 1 else 2) for s in (1, 2) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, s long, t long, d int, k string, v int")
    got = snapshot_changes(df, "g", "s", "t", F.col("k"), F.col("v"), ["d"]).collect()
    assert [(r["key"], r["change"]) for r in got] == [("k00000", "changed")]


def test_field_arithmetic():
    rng = random.Random(1)
    a = np.array([rng.randrange(gf.P) for _ in range(500)] + [0, 1, gf.P - 1], dtype=np.uint64)
    b = np.array([rng.randrange(gf.P) for _ in range(500)] + [gf.P - 1] * 3, dtype=np.uint64)
    assert gf.mul(a, b).tolist() == [int(x) * int(y) % gf.P for x, y in zip(a, b)]
    assert gf.sub(a, b).tolist() == [(int(x) - int(y)) % gf.P for x, y in zip(a, b)]
    assert gf.mul(a[:500], gf.inverse(a[:500])).tolist() == [1] * 500
    v = a[:7, None]
    assert gf.segment_products(v, np.array([0, 3, 4]))[:, 0].tolist() == [np.prod([int(x) for x in a[s]], dtype=object) % gf.P for s in (slice(0, 3), slice(3, 4), slice(4, 7))]


@pytest.mark.parametrize(("na", "nb"), [(3, 2), (0, 5), (4, 4), (1, 0), (0, 0)])
def test_interpolation_recovers_differences(na, nb):
    rng = random.Random(na * 10 + nb)
    common, xa, xb = ([rng.randrange(1 << 60) for _ in range(n)] for n in (20, na, nb))
    z = [int(v) for v in _points(10)]
    value = lambda s: np.array([[np.prod([(p - h) % gf.P for h in s] or [1], dtype=object) % gf.P for p in z]], dtype=np.uint64)
    num, den, ok = interpolate(np.array([20 + na]), np.array([20 + nb]), value(common + xa), value(common + xb), 8)
    assert ok[0] == (na + nb <= 8)
    if ok[0]:
        root = lambda c, h: gf.horner(c, np.array([h], np.uint64))[0] == 0
        assert all(root(num, h) for h in xa) and all(root(den, h) for h in xb) and not any(root(num, h) or root(den, h) for h in common) or not na + nb


def test_reconcile_brute_force(spark, rows):
    rng = random.Random(4)
    a, b = {}, {}
    for i in range(1500):
        k = (f"r{i % 3}" if i % 50 else None, f"k{i}")
        v = (rng.choice(["x", "y", None]), rng.choice([0.5, 1 / 3, None, float("nan")]))
        a[k] = b[k] = v
        u = rng.random()
        if u < 0.1:
            del b[k]
        elif u < 0.2:
            del a[k]
        elif u < 0.3:
            b[k] = ("z", v[1])
        elif u < 0.4 and v[1] and v[1] == v[1]:
            b[k] = (v[0], v[1] + rng.choice([1e-9, 5e-7, 2e-6, 0.1]))
    want = [(*k, "only_a") for k in a.keys() - b.keys()] + [(*k, "only_b") for k in b.keys() - a.keys()]
    for k in a.keys() & b.keys():
        (s, x), (t, y) = a[k], b[k]
        want += [(*k, "s")] if s != t else []
        if (x is None) != (y is None) or x is not None and not (x != x and y != y) and (x != x or y != y or abs(x - y) > 1e-6):
            want.append((*k, "n"))
    make = lambda d: spark.createDataFrame([(*k, *v, 2, "e") for k, v in d.items()] + [(*k, "old", 9.0, 1, "e") for k in list(d)[:200]] + [(*k, *d[k], 2, "e") for k in list(d)[:50]], "g string, k string, s string, n double, at int, side_ string")
    fields = [Field("s", F.col("s")), Field("n", F.col("n"), 1e-6)]
    run = lambda x, y: reconcile(x, y, {"g": F.col("g"), "k": F.col("k")}, fields, "at", ("only_a", "only_b"))
    assert rows(run(make(a), make(b))) == sorted(want, key=repr)
    assert run(make(a), make(a)).count() == 0
    empty = make(a).limit(0)
    assert run(empty, empty).count() == 0
    assert {r["field"] for r in run(make(a), empty).collect()} == {"only_a"}


def test_name_set(spark):
    df = spark.createDataFrame([(["b", None, "a", "b"],), (None,), ([],)], "t array<string>")
    assert [r[0] for r in df.select(name_set(F.col("t"))).collect()] == [["a", "b"], [], []]


def test_document_edges_in_every_envelope(spark, rows):
    dep = lambda *names: [{"resolved": n, "module": "./" + n} for n in names]
    mods = [{"source": "a", "dependencies": dep("b", "c")}, None, {"source": "b", "dependencies": []}]
    plain = json.dumps({"modules": mods}, separators=(",", ":"))
    bodies = [
        plain, json.dumps({"modules": mods}, indent=2), " \n" + plain, "﻿" + plain, json.dumps({"summary": {"error": 0}, "modules": mods}), json.dumps(mods), json.dumps({"graph": {"modules": mods}}), json.dumps({"a": {"b": {"modules": mods}}}),
        json.dumps({"source": "lone", "dependencies": dep("x")}), json.dumps({"modules": {"source": "one", "dependencies": dep("y")[0]}}), json.dumps({"modules": [{"source": "s", "dependencies": [None, "bare", {"module": "m"}, 7]}]}),
        '{"modules":[{"source":"\\ud800","dependencies":["z"]}]}', None, "", "{", plain[:-1], "7", '{"modules":null}', '{"modules":[]}',
    ]
    want = [("a", 0, "b", "./b"), ("a", 1, "c", "./c")] * 8
    want += [("lone", 0, "x", "./x"), ("one", 0, "y", "./y"), ("s", 1, "bare", None), ("s", 2, None, "m"), ("�", 0, "z", None)]
    df = spark.createDataFrame(list(enumerate(bodies)), "record_id long, body string")
    assert rows(document_edges(df, "body")) == sorted(want, key=repr)
    assert rows(document_edges(df, "body", rows_per_batch=1)) == sorted(want, key=repr)
    assert document_edges(df.limit(0), "body").count() == 0
