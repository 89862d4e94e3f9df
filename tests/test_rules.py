"""Patterns, the rule language, verdicts, known findings, questions, sources and reports."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from depweave.functions import order, regex
from depweave.operators import evaluate as ev
from depweave.operators import graph as gr
from depweave.operators import known as kn
from depweave.operators import slices as sl
from depweave.operators import whatif as wi
from depweave.operators.graph import EDGE_COLUMNS, STEP, Graph, complete
from depweave.plans import rules as ru
from depweave.plans.compile import edge_predicate, via
from depweave.sinks import reports as rp
from depweave.sources import graphs as so
from depweave.sources.views import code_graph


def edges(spark, rows):
    cols = "source string, ord long, resolved string, dependencyTypes array<string>"
    return spark.createDataFrame([(a, i, b, t) for i, (a, b, *t2) in enumerate(rows) for t in [t2[0] if t2 else ["local"]]], cols)


def hits(spark, rule, rows, **flags):
    e = complete(edges(spark, rows), EDGE_COLUMNS)
    for k, v in flags.items():
        e = e.withColumn(k, v)
    e = e.withColumn("from_instability", F.lit(None).cast("double"))
    return sorted((r["source"], r["resolved"]) for r in e.where(edge_predicate(ru.rule(rule))).collect())


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [
        ("a$", "a\n", False), ("a$", "ba", True), ("a.b", "a\nb", False), ("a.b", "a\u0085b", True), ("^[^]$", "\n", True), ("[]", "x", False), ("\\s", "﻿", True), ("\\d", "٣", False),
        ("\\bfoo\\b", "a foo.", True), ("\\bx", "éx", True), ("a{,2}", "a{,2}", True), ("[[]", "[", True), ("[a&&b]", "&", True), ("\\/x", "/x", True), ("(a)\\1", "aa", True), ("\\u0041", "A", True), ("", "x", True), ("}", "}", True),
    ],
)
def test_patterns(spark, pattern, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(regex.matches(F.col("s"), pattern)).first()[0] is want


def test_patterns_refused():
    for p in ("(?=a)", "(?<!a)b", "a\\", "[a"):
        with pytest.raises(regex.PatternError):
            regex.to_java(p)
    assert regex.check("(a+)+") and not regex.check("^src/[^/]+$")
    assert regex.escape("a.b/c") == "a\\.b\\/c"
    with pytest.raises(ru.RuleError):
        ru.rule({"from": {"path": "(?=x)"}})


def test_captures_shift_when_a_group_stays_out(spark):
    assert regex.groups("(a)|(b)") == [True, True] and regex.groups("((?:x)?)y") == [False] and regex.groups("(?:(x))?y") == [True]
    c = spark.createDataFrame([("b/q",), ("a/b/q",), ("zzz",), (None,)], "s string")
    got = [list(r[0]) for r in c.select(regex.captured(F.col("s"), "^(a/)?b/(.)")).collect()]
    assert got == [["b/q", "q"], ["a/b/q", "a/", "q"], [], []]
    assert regex.captured(F.col("s"), "abc") is None


def test_capture_fence(spark):
    rule = {"from": {"path": "^apps/([^/]+)/"}, "to": {"path": "^apps/", "pathNot": "^apps/$1/"}}
    assert hits(spark, rule, [("apps/a.x/m", "apps/a.x/n"), ("apps/a.x/m", "apps/ayx/n"), ("apps/b/m", "libs/q")]) == [("apps/a.x/m", "apps/ayx/n")]
    # a pattern without groups replaces nothing
    assert hits(spark, {"from": {"path": "^apps"}, "to": {"path": "$0"}}, [("apps", "apps")]) == []


def test_absent_is_not_false(spark):
    rows = [("a", "b")]
    assert hits(spark, {"to": {"circular": False}}, rows) == []
    assert hits(spark, {"to": {"circular": False}}, rows, circular=F.lit(False)) == [("a", "b")]
    assert hits(spark, {"to": {"licenseNot": "GPL"}}, rows) == []
    assert hits(spark, {"to": {"licenseNot": "GPL"}}, rows, license=F.lit("MIT")) == [("a", "b")]
    assert hits(spark, {"to": {"dependencyTypesNot": ["npm"]}}, [("a", "b", None), ("a", "c", ["npm"]), ("a", "d", [])]) == [("a", "b"), ("a", "d")]
    assert hits(spark, {"to": {"moreThanOneDependencyType": True}}, [("a", "b", ["npm", "npm-dev", None]), ("a", "c", ["npm", "import"])]) == [("a", "b")]


def test_ancestor(spark):
    rows = [("a/b/c", "a/x"), ("a/b/c", "a/b/x"), ("a/x", "a/b/c"), ("a/b/c", "../y")]
    assert hits(spark, {"to": {"ancestor": True}}, rows) == [("a/b/c", "../y"), ("a/b/c", "a/x")]
    assert hits(spark, {"to": {"ancestor": False}}, rows, coreModule=F.lit(True)) == []


def test_via(spark):
    df = spark.createDataFrame([(0, [("a", ["local"]), ("b", ["npm"])]), (1, None), (2, [("b", []), ("b", [])])], f"i int, cycle array<{STEP}>")
    ask = lambda only=False, **kw: [r[0] for r in df.orderBy("i").select(via(ru.Via(**kw), F.col("cycle"), None, only)).collect()]
    assert ask(path="a") == [True, True, False] and ask(only=True, path="b") == [False, True, True]
    assert ask(pathNot="b") == [True, True, False] and ask(only=True, pathNot="a") == [False, True, True]
    # pathNot takes the place of path
    assert ask(path="nothing", pathNot="zzz") == [True, True, True]
    assert ask(dependencyTypes=("npm",)) == [True, True, False] and ask(only=True, dependencyTypesNot=("npm",)) == [False, True, True]


def test_rule_language():
    rs = ru.load({"layers": [{"name": "l", "layers": [{"name": "a", "path": "^a"}, {"name": "b", "path": "^b"}, {"name": "c", "path": "^c"}]}], "independence": [{"name": "i", "pattern": "^p/([^/]+)/"}], "forbidden": [{"name": "x", "severity": "ignore"}]})
    assert [r.name for r in rs.forbidden] == ["l:b-to-a", "l:c-to-a", "l:c-to-b", "i"]
    assert rs.forbidden[-1].to.pathNot == "^p/$1/"
    with pytest.raises(ru.RuleError):
        ru.load({"independence": [{"name": "i", "pattern": "^p/(a)(b)"}]})
    for bad in ({"to": {"dependencyTypes": ["nope"]}}, {"from": {"nope": 1}}, {"severity": "loud"}, {"nope": 1}):
        with pytest.raises(ru.RuleError):
            ru.rule(bad)
    assert ru.load({"allowed": [{}], "allowedSeverity": "ignore"}).allowed == ()
    assert ru.decision_token("see adr:0012, plan:x") == "adr:0012" and ru.decision_token("plan:a-b_c.") == "plan:a-b_c" and ru.decision_token("xadr:1") is None
    r = ru.rule({"to": {"viaNot": "a", "viaSomeNot": ["b", "c"]}})
    assert r.to.viaOnly.pathNot == "a" and r.to.via.pathNot == "b|c"
    assert ru.load({"forbidden": [{"from": {"path": "{{x}}"}}]}, {"x": "^q"}).forbidden[0].from_.path == "^q"
    merged = ru.extend({"forbidden": [{"name": "a", "severity": "warn", "comment": "c"}]}, {"forbidden": [{"name": "a", "severity": "error"}, {"name": "b"}]})
    assert merged["forbidden"] == [{"name": "a", "severity": "error", "comment": "c"}, {"name": "b"}]
    lint = ru.lint(ru.load({"forbidden": [{"name": "a", "replacedBy": "zz"}, {"name": "b", "since": "2.0.0", "deprecated": "1.10.0"}, {"name": "c", "replacedBy": "c"}]}))
    assert lint == [("a", "replaced-by-unknown"), ("b", "since-after-deprecated"), ("c", "replaced-by-self")]
    assert ru.refuse_unrecorded(ru.load({"forbidden": [{"name": "n", "from": {"namespace": "x"}}]}), ["typescript"]) and not ru.refuse_unrecorded(ru.load({"forbidden": [{"name": "n", "from": {"namespace": "x", "language": "dotnet"}}]}), ["typescript", "dotnet"])


def test_orders(spark):
    want = ["$", "0", "1", "5", "9", "a", "B", "m", "Z", "é", "ÿ", "一"]
    assert sorted(reversed(want), key=order.collation_key) == want
    ascii_ = ["_a", "-a", "a", "A", "b", "B", "1", "/", "a.b", "a/b"]
    df = spark.createDataFrame([(x,) for x in ascii_], "s string")
    assert [r[0] for r in df.orderBy(order.collated(F.col("s")), "s").collect()] == sorted(ascii_, key=order.collation_key)
    assert order.sort_versions(["1.10.0", "1.9.0", "1.9.0-rc.1"]) == ["1.9.0-rc.1", "1.9.0", "1.10.0"]
    assert order.precedence("v1.1.0", "1.1.0+x") == 0 and order.precedence("r2", "r10") == -1


def test_violation_ids(spark):
    one = lambda *a: spark.range(1).select(ev.violation_id(*[F.lit(x) for x in a])).first()[0]
    assert one("r", "a", "b", "import") == "RB-e362b09e"
    assert one("no-cross-app-imports", "apps/web/src/x.ts", "apps/worker/src/y.ts", "import") == "RB-a85578a3"


def test_cycle_findings_are_one_per_cycle(spark):
    g = Graph.of(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("x", "a")]))
    r = ev.evaluate(g, ru.load({"forbidden": [{"name": "no-circular", "severity": "error", "comment": "adr:1", "to": {"circular": True}}]}))
    got = [(v["type"], v["from"], v["to"], [s["name"] for s in v["cycle"]], v["decision"]) for v in r.ordered().collect()]
    assert got == [("cycle", "a", "b", ["b", "c", "a"], "adr:1"), ("cycle", "d", "d", ["d"], "adr:1")]
    assert r.exit_code() == 2


def test_allowed_gives_one_finding(spark):
    g = Graph.of(edges(spark, [("a", "b"), ("b", "c")]))
    r = ev.evaluate(g, ru.load({"allowed": [{"from": {"path": "a"}}, {"from": {"path": "q"}}], "allowedSeverity": "error"}))
    assert [(v["rule"], v["from"], v["severity"]) for v in r.violations.collect()] == [("not-in-allowed", "b", "error")]
    assert ev.evaluate(g, ru.load({"allowed": [{"from": {"orphan": True}}]})).violations.where("type = 'dependency'").count() == 0


def test_narrowed_graphs(spark):
    g = Graph.of(edges(spark, [("a", "b"), ("b", "c"), ("a", "x"), ("x", "c")]))
    ask = lambda graph, to="^c": sorted((v["from"], v["to"], tuple(s["name"] for s in v["via"])) for v in ev.evaluate(g, ru.load({"forbidden": [{"name": "r", "from": {"path": "^a"}, "to": {"path": to, "reachable": True}, **({"graph": graph} if graph else {})}]})).violations.collect())
    assert ask(None) == [("a", "c", ("b", "c"))]
    assert ask({"modulesNot": "^b"}) == [("a", "c", ("x", "c"))]
    assert ask({"chainsThrough": "^q"}) == []
    assert ask({"ignore": [{"from": "^a"}]}) == []
    assert ask({"redirect": [{"to": "^x", "into": "a"}], "ignore": [{"from": "^b"}]}) == []
    rs = ru.load({"forbidden": [{"name": "r", "from": {"path": "^a"}, "graph": {"ignore": [{"from": "^a", "to": "^b"}, {"from": "^zz"}]}}]})
    assert ev.vacuous(g, rs) == ["r"]


def _beyond_a_task(monkeypatch):
    """A task takes four pairs, and no search by rounds is there."""
    from depweave.operators import graph as gr, local

    monkeypatch.setattr(local, "PAIRS", 4)
    for f in ("_reach", "_paths", "_components"):
        monkeypatch.setattr(gr, f, None)


def test_reach_rules_over_pieces(spark, rows, monkeypatch):
    _beyond_a_task(monkeypatch)
    g = Graph.of(edges(spark, [("1/a/x", "1/m"), ("1/m", "1/t/z"), ("1/m", "fs"), ("1/t/z", "1/a/x"), ("2/a/x", "2/t/z"), ("2/t/z", "fs")]))
    rs = ru.load({"forbidden": [{"name": "far", "severity": "error", "from": {"path": "/a/"}, "to": {"path": "/t/|^fs|/a/", "reachable": True}}]})
    assert rows(ev.module_violations(g, rs).select("from", "to", F.size("via").alias("n"))) == [("1/a/x", "1/t/z", 2), ("1/a/x", "fs", 2), ("2/a/x", "2/t/z", 1), ("2/a/x", "fs", 2)]


def test_cycle_rules_over_pieces(spark, rows, monkeypatch):
    _beyond_a_task(monkeypatch)
    g = Graph.of(edges(spark, [("1/a", "1/b"), ("1/b", "1/a"), ("1/b", "fs"), ("2/a", "2/a"), ("2/a", "fs"), ("3/a", "3/b")]))
    rs = ru.load({"forbidden": [{"name": "loop", "severity": "error", "to": {"circular": True}}]})
    assert rows(ev.evaluate(g, rs).violations.select("from", "to", F.size("cycle").alias("n"))) == [("1/a", "1/b", 2), ("2/a", "2/a", 1)]


def _random_graph(spark, seed):
    import random

    rng = random.Random(seed)
    ends = [(f"{k}{rng.randrange(n)}", f"{k}{rng.randrange(n)}") for k, n, m in (("a", 8, 30), ("b/node_modules/", 4, 9), ("c", 9, 14), ("d", 1, 1)) for _ in range(m)]
    types = [["local"], ["npm"], ["local", "npm"], None]
    rows = [(a, i, b, rng.choice(types), rng.choice(["import", "inherits", None])) for i, (a, b) in enumerate([*ends, ("a0", "b/node_modules/0"), ("b/node_modules/1", "a1")])]
    return spark.createDataFrame(rows, "source string, ord long, resolved string, dependencyTypes array<string>, dependencyKind string")


@pytest.mark.parametrize(
    "to",
    [
        [{}],
        [{"viaOnly": {"pathNot": "node_modules"}}],
        [{"via": {"path": "[02468]$"}}, {"viaOnly": {"path": "^a"}}, {"via": {"pathNot": "3$", "dependencyTypes": ["npm"]}, "viaOnly": {"dependencyTypesNot": ["core"]}}],
        [{"viaOnly": {"dependencyTypes": ["local"]}}, {"via": {"dependencyTypesNot": ["local"]}, "dependencyTypes": ["npm"]}],
    ],
)
def test_counted_cycles_give_the_findings_of_whole_ones(spark, rows, to):
    for seed in (1, 2):
        g = Graph.of(_random_graph(spark, seed))
        rs = ru.load({"forbidden": [{"name": f"r{i}", "severity": "error", "comment": f"c{i}", "to": {"circular": True, **t}} for i, t in enumerate(to)]})
        want = ev.evaluate(g, rs).violations.withColumn("steps", F.size("cycle")).drop("cycle")
        got = ev.cycle_findings(g, rs)
        assert sorted(got.columns) == sorted(want.columns)
        told = lambda df: sorted(map(str, df.select(*sorted(want.columns)).collect()))  # noqa: B023, E731
        assert told(got) == told(want) != []


def test_findings_about_captured_groups_take_whole_cycles(spark):
    g = Graph.of(edges(spark, [("x1", "y1"), ("y1", "x1"), ("x2", "y3"), ("y3", "x2")]))
    rs = ru.load({"forbidden": [{"name": "own", "severity": "warn", "from": {"path": "^[xy]([0-9])"}, "to": {"circular": True, "viaOnly": {"path": "^[xy]$1"}}}]})
    assert [(r["rule"], r["from"], r["steps"]) for r in ev.cycle_findings(g, rs).collect()] == [("own", "x1", 2)]


def test_cycle_rule_writes_no_cycle_out(spark, rows, monkeypatch, tmp_path):
    from depweave.plans.graph_queries import QUERIES

    e = _random_graph(spark, 3).selectExpr("1L AS run_id", "'r' AS repo", "*", "source AS module", "false AS coreModule", "false AS couldNotResolve", "false AS matchesDoNotFollow")
    e.write.parquet(str(tmp_path / "edges.parquet"))
    rs = ru.load({"forbidden": [{"name": "no-circular", "severity": "error", "to": {"circular": True, "viaOnly": {"pathNot": "node_modules"}}}]})
    want = rows(ev.evaluate(code_graph(spark, str(tmp_path)), rs).violations.select("from", "to", "rule", F.size("cycle").alias("steps"), "id"))
    monkeypatch.setattr(ev, "cycles", None)
    monkeypatch.setattr(gr, "cycles", None)
    assert want and rows(QUERIES["v09_cycle_rule"](spark, str(tmp_path))) == want


def test_circular_components_take_no_search_of_cycles(spark, rows, monkeypatch, tmp_path):
    import random

    from depweave.plans.rule_queries import QUERIES

    rng = random.Random(5)
    pairs = sorted({(f"{k}{rng.randrange(n)}", f"{k}{rng.randrange(n)}") for k, n, m in (("a", 6, 9), ("b", 5, 12), ("c", 9, 9), ("d", 1, 1)) for _ in range(m)})
    e = edges(spark, pairs).selectExpr("1L AS run_id", "'r' AS repo", "*", "source AS module", "'import' AS dependencyKind", "false AS coreModule", "false AS couldNotResolve", "false AS matchesDoNotFollow")
    e.write.parquet(str(tmp_path / "edges.parquet"))
    g = code_graph(spark, str(tmp_path))
    v = ev.evaluate(g, ru.load({"forbidden": [{"name": "no-circular", "severity": "error", "to": {"circular": True}}]})).violations
    want = rows(v.join(gr.components(g.pairs), v["from"] == F.col("node")).select("scc", "rule", "severity").distinct())
    monkeypatch.setattr(ev, "cycles", None)
    monkeypatch.setattr(gr, "cycles", None)
    assert want and rows(QUERIES["v09_circular_components"](spark, str(tmp_path))) == want


def test_expiry_is_the_day_after():
    rs = ru.load({"forbidden": [{"name": "r", "expires": "2026-01-31"}]})
    assert ev.expired(rs, date(2026, 1, 31)) == [] and ev.expired(rs, date(2026, 2, 1)) == ["r"]


KN = "type string, rule string, severity string, `from` string, `to` string, id string"


def test_known_findings(spark, rows):
    v = complete(spark.createDataFrame([("dependency", "r", "error", "a", "b", "1"), ("module", "m", "error", "a", "a", "2"), ("element", "e", "warn", "f", "T", "3"), ("dependency", "r", "error", "x", "y", "4")], KN), kn.KNOWN)
    k = complete(
        spark.createDataFrame([("dependency", "r", None, "a", "b", None, None), ("reachability", "m", None, "a", "zz", None, date(2026, 1, 1)), ("element", "e", None, None, "T", None, None), ("dependency", "r", None, "gone", "b", None, None), (None, None, None, None, None, "4", None)], KN + ", expires date"),
        kn.KNOWN,
    )
    soft = kn.soften(v, k, date(2026, 1, 2))
    # the module entry has expired: it matches and does not soften
    assert rows(soft, "id", "severity") == [("1", "ignore"), ("2", "error"), ("3", "ignore"), ("4", "ignore")]
    assert rows(kn.soften(v, k, date(2026, 1, 1)).where("id = '2'"), "severity") == [("ignore",)]
    assert rows(kn.stale(v, k, date(2026, 1, 2)), "from") == [("gone",)] and kn.observed(v, k, date(2026, 1, 2)).count() == 4
    assert rows(kn.expired_entries(k, date(2026, 1, 2)), "name") == [("a -> zz",)]
    assert rows(kn.baseline(v, k, date(2026, 1, 2), "shrink-only"), "id") == [("1",), ("2",), ("3",), ("4",)]
    assert rows(kn.restore_severities(soft, ru.load({"forbidden": [{"name": "r", "severity": "error"}]})).where("rule = 'r'"), "severity") == [("error",), ("error",)]
    two = v.unionByName(v.where("id = '1'"))
    got = kn.diff_violations(two, v.where("id != '4'").withColumn("severity", F.lit("info"))).groupBy("state").count()
    assert rows(got) == [("old", 2), ("same", 3)]


def test_ratchets(spark, rows):
    g = Graph.of(edges(spark, [("a/x", "b/y"), ("a/z", "b/y"), ("c", "a/x")]))
    rs = ru.load({"ratchets": [{"name": "r", "from": {"path": "^a"}, "to": {"path": "^b", "dependencyTypes": ["npm"]}, "max": 1}, {"name": "s", "to": {"path": "^a"}}]})
    assert rows(kn.ratchet_counts(g, rs.ratchets, {"s": 5}), "name", "count", "verdict", "by") == [("r", 2, "over", 1), ("s", 1, "within", 4)]
    assert kn.lower_budget(3, 5) == 3
    with pytest.raises(ValueError):
        kn.lower_budget(6, 5)


def test_questions(spark, rows):
    g = Graph.of(edges(spark, [("a/x", "b/y"), ("b/y", "c/z"), ("d/q", "c/z")]))
    rs = ru.load({"forbidden": [{"name": "r", "severity": "error", "from": {"path": "^c"}, "to": {"path": "^b"}, "examples": {"forbidden": ["c/1 -> b/1"], "allowed": ["b/1 -> c/1", "c/2 -> b/2"]}}, {"name": "cyc", "severity": "error", "to": {"circular": True}}]})
    c = spark.createDataFrame([("c/z", "a/x"), ("c/z", "b/y"), ("a/x", "d/q"), ("n/w", "a/x")], "`from` string, `to` string")
    got = {(r["from"], r["to"]): (r["allowed"], r["circular"], r["rules"]) for r in wi.can_import(g, rs, c).collect()}
    assert got == {("c/z", "a/x"): (False, True, ["cyc"]), ("c/z", "b/y"): (False, True, ["cyc", "r"]), ("a/x", "d/q"): (True, False, []), ("n/w", "a/x"): (True, False, [])}
    assert rows(wi.run_examples(spark, ru.load({"forbidden": [{"name": "r", "severity": "error", "from": {"path": "^c"}, "to": {"path": "^b"}, "examples": {"forbidden": ["c/1 -> b/1"], "allowed": ["b/1 -> c/1", "c/2 -> b/2"]}}]})), "edge", "passed") == [("b/1 -> c/1", True), ("c/1 -> b/1", True), ("c/2 -> b/2", False)]
    d = spark.createDataFrame([("a/b/c", "a/d"), ("", "a/b"), ("a", "a"), ("x", "y")], "a string, b string")
    assert [r[0] for r in d.select(wi.folder_distance(F.col("a"), F.col("b"))).collect()] == [3, 2, 0, 2]
    p = wi.place(g, ru.load({"forbidden": rs_dict(rs)}), "new", ["b/y"])
    assert {r["folder"]: r["legal"] for r in p.collect()} == {"a": True, "b": True, "c": False, "d": True}
    ch = spark.createDataFrame([("c/z", "modified", None), ("new", "renamed", "b/y")], "path string, kind string, old_path string")
    assert rows(wi.affected(g, ch)) == [("a/x", 1), ("b/y", 0), ("c/z", 0), ("d/q", 1)]
    f = wi.fix_plans(g, ru.load({"forbidden": [{"name": "ab", "severity": "error", "from": {"path": "^a"}, "to": {"path": "^b"}}]}), ev.evaluate(g, ru.load({"forbidden": [{"name": "ab", "severity": "error", "from": {"path": "^a"}, "to": {"path": "^b"}}]})).violations)
    assert [(r["from"], r["plan"], r["target"], r["cost"]) for r in f.collect()] == [("a/x", "move", "b/x", 1)]


def _plans(spark, es, forbidden):
    g, rs = Graph.of(edges(spark, es)), ru.load({"forbidden": [{"severity": "error", **r} for r in forbidden]})
    return sorted((r["from"], r["to"], r["plan"], r["target"], r["cost"]) for r in wi.fix_plans(g, rs, ev.evaluate(g, rs).violations).collect())


def test_fix_plans_judge_all_edges_they_add(spark):
    ab = {"name": "ab", "from": {"path": "^a/"}, "to": {"path": "^b/"}}
    # the legal folder lies in none of the source's targets' folders
    far = {"name": "far", "from": {"path": "^b/x"}, "to": {"path": "^b/"}}
    assert _plans(spark, [("a/x", "b/y"), ("d/q", "d/r")], [ab, far]) == [("a/x", "b/y", "move", "d/x", 1)]
    # an importer may not follow to b, nor to d
    stay = {"name": "stay", "from": {"path": "^a/i"}, "to": {"path": "^[bd]/"}}
    assert _plans(spark, [("a/x", "b/y"), ("a/i", "a/x"), ("d/q", "d/r")], [ab, stay]) == [("a/x", "b/y", "port", "a/port-y", 2)]
    # the target may not depend on a port there either, so the edge is turned
    port = {"name": "port", "from": {"path": "^b/y"}, "to": {"path": "port-"}}
    assert _plans(spark, [("a/x", "b/y"), ("a/i", "a/x"), ("d/q", "d/r")], [ab, stay, port]) == [("a/x", "b/y", "invert", "a/x", 2)]


def test_fix_plans_of_reachability(spark):
    got = _plans(spark, [("a/x", "m/y"), ("m/y", "c/z")], [{"name": "far", "from": {"path": "^a/"}, "to": {"path": "^c/", "reachable": True}}])
    assert got == [("a/x", "c/z", "move", "c/x", 1)]


def rs_dict(rs):
    return [{"name": "r", "severity": "error", "from": {"path": "^c"}, "to": {"path": "^b"}}]


def test_fix_plans_meet_each_folder_once(spark, rows):
    names = ["1", "1/a", "1/a/x", "1/a/x/u", "1/a/y", "1/b", "1/b/x", "2", "2/a", "2/a/x", "1a", "/r", "/r/a"]
    w = spark.createDataFrame([(n, "ts") for n in names], "folder string, language string").withColumn("w_", wi._ways_up(F.col("folder"))).withColumn("x_", F.explode("w_"))
    folders = w.select("folder", "language", (F.size("w_") - 1).alias("df_"), "x_.j_", "x_.up_", F.get("w_", F.col("x_.j_") + 1)["up_"].alias("next_"))
    ends = [("1/a/x", "1/b/x"), ("1/a/x/u", "2/a"), ("1/a", "1/a"), ("", "1/b"), ("/r/a", "1")]
    v = spark.createDataFrame([(a, b, "ts") for a, b in ends], "ha_ string, hb_ string, la_ string").withColumns({"wa_": wi._ways_up(F.col("ha_")), "wb_": wi._ways_up(F.col("hb_")), "apart_": wi.folder_distance(F.col("ha_"), F.col("hb_"))})
    each = v.crossJoin(folders.select("folder").distinct()).withColumns({"x": wi.folder_distance(F.col("folder"), F.col("ha_")), "y": wi.folder_distance(F.col("folder"), F.col("hb_"))})
    for plan, away, least in (("move", F.col("x"), F.lit(0)), ("port", F.col("x") + F.col("y"), F.col("apart_"))):
        all_ = 0
        for low, high in zip(wi._RINGS[plan], wi._RINGS[plan][1:]):
            want = each.withColumn("away", away).where((F.col("away") - least > low) & (F.col("away") - least <= high))
            got = rows(wi._near(v, folders, plan, low, high, 4), "ha_", "hb_", "folder", "away")
            assert got == rows(want, "ha_", "hb_", "folder", "away")
            all_ += len(got)
        assert all_ == len(ends) * len(names) - (plan == "move") * 4  # nothing moves to where it lies


def test_touching(spark, rows):
    v = complete(spark.createDataFrame([("dependency", "r", "e", "a", "b", "1"), ("folder", "r", "e", "s", "t", "2"), ("reachability", "r", "e", "q", "a", "3"), ("dependency", "r", "e", "z", "a", "4")], KN), kn.KNOWN)
    assert rows(wi.touching(v, spark.createDataFrame([("a",), ("s/x/y",)], "source string")), "id") == [("1",), ("2",), ("3",)]


def test_snapshots_over_releases(spark, rows):
    s = spark.createDataFrame([("1.9.0", "fromMatches", "a", 0.0), ("1.10.0", "fromMatches", "a", 0.0), ("1.9.0", "toMatches", "a", 0.0), ("1.10.0", "fromMatches", "b", 0.0), ("1.9.0", "fromMatches", "b", 2.0), ("1.9.0", "fromMatches", "c", 1.0), ("1.9.0", "ratchets", "r", 5.0), ("1.10.0", "ratchets", "r", 4.0)], "version string, section string, name string, value double")
    assert rows(wi.unused_rules(s, 1)) == [("a",), ("b",)] and rows(wi.unused_rules(s, 2)) == [("a",)]
    assert wi.retired_rules(s, "1.9.0", "1.10.0", ru.load({"forbidden": [{"name": "b", "deprecated": "1.10.0"}]})) == [("b", False), ("c", True)]
    assert rows(wi.fallen_ratchets(s, "1.9.0", "1.10.0")) == [("r", 5.0, 4.0)]


def test_slices(spark, rows):
    df = spark.createDataFrame([("x/libs/a/b.ts",), ("x/apps/q.ts",), ("libs/c/d.ts",), (None,)], "s string")
    name = lambda p, **kw: [r[0] for r in df.select(sl.slice_name(F.col("s"), sl.parse(p, **kw))).collect()]
    assert name("/libs/(*)", segments=1) == ["a", None, "c", None]
    assert name("libs/(**)/d.ts") == [None, None, "c", None]
    assert name("/libs/(*)", segments=1, ignore=["a"]) == [None, None, "c", None]
    for bad in ("a", "(*)/(**)", "(**)/(**)"):
        with pytest.raises(ValueError):
            sl.parse(bad)
    g = Graph.of(edges(spark, [("s/a/1", "s/b/1"), ("s/b/2", "s/a/2"), ("s/b/1", "s/c/1"), ("s/a/1", "s/a/2"), ("s/a/2", "s/b/2"), ("s/c/1", "zz")]))
    e = sl.slice_edges(g, sl.parse("s/(*)", segments=1))
    assert rows(e, "from", "to") == [("a", "b"), ("b", "a"), ("b", "c")]
    assert rows(sl.free_of_cycles(e), "component", "slices", "edges") == [("a", ["a", "b"], 3)]


def test_documents(spark, tmp_path, rows):
    (tmp_path / "g.json").write_text('{"modules":[{"source":"a.ts","dependencies":[{"resolved":"b.py","module":"./b","dependencyTypes":["local"],"circular":false},{"resolved":"fs","coreModule":true}]},{"source":"b.py","dependencies":[]}]}')
    g = so.read_document(spark, str(tmp_path / "g.json"))
    assert rows(g.edges, "source", "ord", "resolved", "coreModule", "circular") == [("a.ts", 0, "b.py", None, False), ("a.ts", 1, "fs", True, None)]
    assert rows(g.modules, "source", "language") == [("a.ts", "typescript"), ("b.py", "python")]
    i = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "../x/y"), ("src/a.ts", "@/q"), ("src/a.ts", "nope")], "source string, module string")
    k = spark.createDataFrame([("src/b.ts",), ("x/y/index.ts",), ("src/q.js",)], "source string")
    assert rows(so.resolve(i, k, {"@/": "src/"}), "module", "resolved", "couldNotResolve") == [("../x/y", "x/y/index.ts", False), ("./b", "src/b.ts", False), ("@/q", "src/q.js", False), ("nope", "nope", True)]


def test_declared_and_openapi(spark, rows):
    g = Graph.of(edges(spark, [("a", "b")]))
    done, skipped = so.apply_declared(g, so.read_declared(spark, '{"declared":[{"from":"a","to":"b","kind":"x"},{"from":"a","to":"gone"}]}'))
    assert done.edges.where("dependencyKind = 'declared'").count() == 1 and rows(skipped, "to") == [("gone",)]
    ops = so.read_openapi(spark, '{"paths":{"/p":{"get":{"operationId":"getP","x-handler":"./h.cs"},"post":{"operationId":"none"}},"/r":{"$ref":"x"}}}')
    assert ops.count() == 2
    cl = spark.createDataFrame([("web/c.ts", "getP"), ("web/d.ts", "other")], "file string, name string")
    assert rows(so.openapi_edges(ops, cl, "srv/api"), "from", "to", "comment") == [("web/c.ts", "srv/api/h.cs", "operation getP (GET /p)")]


def test_change_lists(spark, rows):
    lines = spark.createDataFrame([("M\ta.ts",), ("R100\told.ts\tnew.ts",), ("D  x",), ("Q\ty",), ("R10\ta\tb",), ("M\ta b c",)], "l string")
    assert rows(so.diff_lines(lines, "l")) == [("a.ts", "modified", None), ("new.ts", "renamed", "old.ts"), ("x", "deleted", None)]
    st = spark.createDataFrame([(" M a.ts",), ("R  o.ts -> n.ts",), ("?? z",)], "l string")
    assert rows(so.status_lines(st, "l")) == [("a.ts", "modified", None), ("n.ts", "renamed", "o.ts"), ("z", "untracked", None)]


def test_fleet(spark, rows):
    a, b = Graph.of(edges(spark, [("x", "y")])), Graph.of(edges(spark, [("x", "z")]))
    f = wi.fleet({"a": a, "b": b})
    assert rows(f.edges, "source", "resolved") == [("a/x", "a/y"), ("b/x", "b/z")] and f.modules.count() == 4


def test_fleet_holds_every_repository(spark, rows):
    data = [(r, "x", i, t, t == "fs", False) for r in ("c", "a", "b", "d") for i, t in enumerate(["y", "fs", "x"])] + [("b", "fs", 0, "y", False, False)]
    e = spark.createDataFrame(data, "repo string, source string, ord long, resolved string, coreModule boolean, couldNotResolve boolean")
    one, many = wi.fleet_table(e), wi.fleet({r: Graph.of(e.where(F.col("repo") == r)) for r in "abcd"})
    assert rows(one.edges, "source", "ord", "resolved") == rows(many.edges, "source", "ord", "resolved") and one.edges.count() == 13
    assert rows(one.modules, "source", "coreModule") == rows(many.modules, "source", "coreModule")


def test_fleet_query_leaves_no_repository_out(spark, rows, tmp_path):
    from depweave.plans.graph_queries import QUERIES

    e = spark.createDataFrame([(r, "x", 0, "y") for r in "abcd"], "repo string, source string, ord int, resolved string").withColumn("coreModule", F.lit(False)).withColumn("couldNotResolve", F.lit(False))
    e.write.parquet(str(tmp_path / "edges.parquet"))
    assert rows(QUERIES["s19_fleet"](spark, str(tmp_path))) == [(f"{r}/x", f"{r}/y") for r in "abcd"]


def test_reports(spark):
    e = spark.createDataFrame([("b", 0, "a", ["local"], None), ("a", 0, "b", ["local"], None), ("a", 1, "fs", ["core"], True)], "source string, ord long, resolved string, dependencyTypes array<string>, coreModule boolean")
    g = Graph.of(e)
    rs = ru.load({"forbidden": [{"name": "r", "severity": "error", "from": {"path": "^b"}, "to": {"path": "^a"}}]})
    r = ev.evaluate(g, rs)
    done = ev.with_verdicts(r.graph, r.violations)
    assert list(rp.csv(done)) == ['"","a","b","fs",""', '"a","false","true","true",""', '"b","error","false","false",""', '"fs","false","false","false",""']
    assert [x[0] for x in rp.text(g).collect()] == ["a → b", "a → fs", "b → a"]
    for name in rp.REPORTERS:
        lines = list(rp.report(ev.Result(done, rs, r.violations), name))
        assert lines, name
    assert any("RB-" in x for x in rp.report(r, "sarif"))
    assert list(rp.report(r, lambda x: iter(["mine"]))) == ["mine"]
    with pytest.raises(ValueError):
        rp.report(r, "nope")
    anon = rp.anonymize(Graph.of(edges(spark, [("src/secret/a.ts", "src/secret/b.ts")])), ["one", "two"]).edges.first()
    assert anon["source"].startswith("src/") and "secret" not in anon["source"] and anon["source"].split("/")[1] == anon["resolved"].split("/")[1]
    assert rp.attestation({"a": b"1", "b": b"2"}) == rp.attestation({"b": b"2", "a": b"1"})


def test_anonymous_names_stay_apart(spark):
    names = [f"{a}{b}/{c}{d}.x9" for a in "abcd" for b in "AbCd" for c in "pq" for d in "rs~"]
    g = Graph.of(edges(spark, [(n, names[(i * 7 + 1) % len(names)]) for i, n in enumerate(names)]))
    one = rp.anonymize(g, ["w"], key="k").edges.select("source", "resolved").collect()
    assert len({r[0] for r in one}) == len(names) and {r[0] for r in one} == {r[1] for r in one}
    parts = {n.split("/")[0] for n in names}
    assert len({r[0].split("/")[0] for r in one}) == len(parts)
    assert sorted(rp.anonymize(g, ["w"], key="k").edges.select("source", "resolved").collect()) == sorted(one)
    assert sorted(rp.anonymize(g, ["w"]).edges.select("source", "resolved").collect()) != sorted(one)


def test_matrix_with_odd_names(spark):
    g = Graph.of(edges(spark, [('a,"b', "c")]))
    r = ev.Result(g, ru.load({}), None)
    assert list(rp.csv(g)) == ['"","a,""b","c",""', '"a,""b","false","undefined",""', '"c","false","false",""']
    page = "".join(rp.html(r))
    assert page.count("<tr>") == 3 and "<th>a,&quot;b</th>" in page.replace('"b</th>', "&quot;b</th>") and "<td class=\"undefined\">undefined</td>" in page
    assert any("fs" in x or "->" in x for x in rp.fdot(r)) and "->" in "".join(rp.cdot(r, "^."))


def test_explain(spark):
    g = Graph.of(edges(spark, [(f"a{i:02d}", "b") for i in range(15)]))
    s, e = wi.explain(g, ru.rule({"name": "r", "from": {"path": "^a"}, "to": {"path": "^b"}}))
    assert s == "No module matching ^a may depend on a module matching ^b." and [r[0] for r in e.collect()] == [f"a{i:02d}" for i in range(10)]


def test_rewrap(spark, rows):
    g = Graph.of(edges(spark, [("a/x/1", "b/y/1"), ("a/x/1", "b/y/2"), ("a/x/2", "c/z/1"), ("b/y/1", "b/y/2")]))
    rs = ru.load({"forbidden": [{"name": "r", "severity": "error", "from": {"path": "^a"}, "to": {"path": "2$|^c"}}]})
    r = ev.evaluate(g, rs)
    assert rows(ev.rewrap(r, {"exclude": "^c"}).violations, "from", "to") == [("a/x/1", "b/y/2")]
    c = ev.rewrap(r, {"collapse": "^[^/]+/[^/]+"})
    # the edge a/x -> b/y is stood for by its first member, which breaks no rule
    assert rows(c.violations, "from", "to") == [("a/x", "c/z")] and rows(c.graph.edges, "source", "resolved") == [("a/x", "b/y"), ("a/x", "c/z")]
    assert ev.rewrap(r, {}).violations.count() == r.violations.count()


def test_sizes(spark):
    from depweave.operators.metrics import utf16_length

    assert [r[0] for r in spark.createDataFrame([("a",), ("é",), ("😀",), ("",), (None,)], "s string").select(utf16_length(F.col("s"))).collect()] == [1, 1, 2, 0, None]
    g = Graph.of(edges(spark, [("a/x", "b/y")]))
    assert wi.count(g, "^a", "^b", 3) == (1, "within", 2)


def test_reach_queries_write_what_they_ask_for(spark, rows, tmp_path):
    e = edges(spark, [("apps/a/x", "apps/a/y", ["import"]), ("apps/a/y", "shared/z"), ("shared/z", "fs")]).selectExpr("1L AS run_id", "'r' AS repo", "*", "source AS module", "resolved = 'fs' AS coreModule", "false AS couldNotResolve", "false AS matchesDoNotFollow")
    e.write.parquet(str(tmp_path / "edges.parquet"))
    whole, lean = code_graph(spark, str(tmp_path)), code_graph(spark, str(tmp_path), asked=["dependencyTypes"])
    cols = ["source", "ord", "resolved", "dependencyTypes"]
    assert rows(lean.edges, *cols) == rows(whole.edges, *cols) and rows(lean.modules) == rows(whole.modules)
    written = spark.read.parquet(lean.edges.inputFiles()[0].rsplit("/", 1)[0]).columns
    assert sorted(written) == sorted([*cols, "coreModule", "couldNotResolve", "matchesDoNotFollow"])
    assert set(lean.modules.inputFiles()) == set(lean.edges.inputFiles())
