"""Queries for the parts of the rule language, of evaluation, baselines, questions and reports, with their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depweave.functions import order, regex
from depweave.functions.paths import dirname, normalize_dots
from depweave.operators import evaluate as ev, filters, graph as gr, known as kn, metrics as me, whatif as wi
from depweave.operators.graph import STEP, Graph
from depweave.plans import element_queries as eq, rules as ru
from depweave.plans.compile import edge_predicate, needs
from depweave.plans.graph_queries import _DIR, _FOLDERS, _KNOWN, _METRICS, _PROJECTS, _RULED, _SCC, _known, RULES, TODAY, code, ruled
from depweave.session import materialize, shared_dir
from depweave.sinks import reports as rp
from depweave.sources import code as sc, graphs as so
from depweave.sources.views import code_graph, table
from depweave.streaming import edges as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def q(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__], SQL[name or f.__name__] = f, sql
        return f

    return put


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- edge predicates over edges with every property ---------------------------


def dressed(g: Graph) -> Graph:
    """Edges with the properties that the table lacks, each taking all its values; cycles are of two steps."""
    none = F.array().cast("array<string>")
    cycle = F.array(F.struct(F.col("resolved").alias("name"), F.coalesce("dependencyTypes", none).alias("dependencyTypes")), F.struct(F.col("source").alias("name"), F.array(F.lit("import")).alias("dependencyTypes")))
    up = F.concat(F.regexp_replace(F.regexp_replace("source", "/[^/]*$", ""), "/[^/]*$", ""), F.lit("/top.ts"))
    e = g.edges.withColumn("preCompilationOnly", F.col("typeOnly")).withColumn("license", F.when(F.col("ord") % 3 == 0, "MIT").when(F.col("ord") % 3 == 1, "GPL-3.0")).withColumn("exoticRequire", F.when(F.col("dynamic"), "use"))
    e = e.withColumn("cycle", F.when(F.col("followable"), cycle).cast(f"array<{STEP}>")).withColumn("circular", F.col("followable"))
    turn = (F.col("ord") % 3 == 0) & ~F.col("coreModule") & ~F.col("couldNotResolve")
    return g.with_(edges=e.withColumn("resolved", F.when(turn, up).otherwise(F.col("resolved"))))


_TOP = "CASE WHEN ord % 3 = 0 AND NOT coreModule AND NOT couldNotResolve THEN regexp_replace(regexp_replace(source, '/[^/]*$', ''), '/[^/]*$', '') || '/top.ts' ELSE resolved END"
_DRESSED = f"d AS (SELECT source, ord, {_TOP} AS resolved, resolved AS step, dependencyTypes, coreModule, couldNotResolve, typeOnly AS pco, CASE ord % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL-3.0' END AS license, CASE WHEN dynamic THEN 'use' END AS exotic, followable AS circ FROM e)"


def _edge(name: str, rule: dict, where: str) -> None:
    @q(code(f"SELECT source, ord, resolved FROM d WHERE {where}", _DRESSED), name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = dressed(code_graph(spark, d, saved=False)).edges.withColumn("from_instability", F.lit(None).cast("double"))
        return e.where(edge_predicate(ru.rule(rule))).select("source", "ord", "resolved")


_LIB = lambda c: f"regexp_matches({c}, '/libs/')"
_edge("edge_p01_joined_patterns", {"from": {"path": ["^0/", "/libs/.*\\.ts$"]}}, "regexp_matches(source, '^0/|/libs/.*\\.ts$')")
_edge("edge_p03_property_equals", {"to": {"preCompilationOnly": False}}, "pco = false")
_edge("edge_p03_property_true", {"to": {"preCompilationOnly": True, "circular": True}}, "pco AND circ")
_edge("edge_p04_property_matches", {"to": {"license": "GPL|X"}}, "coalesce(license, '') != '' AND regexp_matches(license, 'GPL|X')")
_edge("edge_p05_property_does_not_match", {"to": {"licenseNot": "GPL"}}, "coalesce(license, '') != '' AND NOT regexp_matches(license, 'GPL')")
_edge("edge_p16_via", {"to": {"via": {"path": "/libs/"}}}, f"NOT circ OR {_LIB('step')} OR {_LIB('source')}")
_edge("edge_p17_via_only", {"to": {"viaOnly": {"path": "/libs/"}}}, f"NOT circ OR {_LIB('step')} AND {_LIB('source')}")
_edge("edge_p18_via_types", {"to": {"via": {"dependencyTypes": ["npm"]}, "circular": True}}, "circ AND list_has_any(coalesce(dependencyTypes, []), ['npm'])")
_edge("edge_p18_via_only_types_not", {"to": {"viaOnly": {"dependencyTypesNot": ["local"]}}}, "NOT circ OR NOT list_has_any(coalesce(dependencyTypes, []), ['local'])")
_edge("edge_p19_via_not", {"to": {"viaNot": "/libs/"}}, f"NOT circ OR NOT ({_LIB('step')} OR {_LIB('source')})")
_edge("edge_p19_via_some_not", {"to": {"viaSomeNot": ["/libs/"]}}, f"NOT circ OR NOT ({_LIB('step')} AND {_LIB('source')})")
_FOLDER = lambda c: f"regexp_replace({c}, '[^/]*$', '')"
_ABOVE = f"starts_with({_FOLDER('source')}, {_FOLDER('resolved')}) AND length({_FOLDER('source')}) > length({_FOLDER('resolved')})"
_edge("edge_p22_ancestor", {"to": {"ancestor": True}}, f"NOT coreModule AND NOT couldNotResolve AND {_ABOVE}")
_edge("edge_p22_no_ancestor", {"to": {"ancestor": False}}, f"NOT coreModule AND NOT couldNotResolve AND NOT ({_ABOVE})")
_edge("edge_p23_circular", {"to": {"circular": True}}, "circ")
_edge("edge_p25_exotic_and_license", {"to": {"exoticRequire": "^us", "licenseNot": "MIT"}}, "exotic = 'use' AND license IS NOT NULL AND license != 'MIT'")
_edge("edge_p25_exotic_not", {"to": {"exoticRequireNot": "^x", "license": "MIT"}}, "exotic = 'use' AND license = 'MIT'")
_edge("edge_p31_pattern_dialect", {"from": {"path": "\\/packages\\/[^]*\\.ts$"}}, "regexp_matches(source, '/packages/.*\\.ts$')")
_edge("edge_p32_back_reference", {"from": {"path": "([a-z])\\1"}}, "regexp_matches(source, '" + "|".join(c * 2 for c in "abcdefghijklmnopqrstuvwxyz") + "')")
_edge("z02_escaped_captures", {"from": {"path": "^([0-9]+)/([^/]+/[^/]+)/.*\\.(ts|py)$"}, "to": {"path": "^$1/$2/"}}, "regexp_matches(source, '^[0-9]+/[^/]+/[^/]+/.*\\.(ts|py)$') AND starts_with(resolved, regexp_extract(source, '^([0-9]+/[^/]+/[^/]+/)', 1))")
_edge("u03_defines", ru.substitute({"from": {"path": "^{{run}}/"}, "to": {"path": "{{ libs }}"}}, {"run": "[0-3]", "libs": "/libs/"}), "regexp_matches(source, '^[0-3]/') AND regexp_matches(resolved, '/libs/')")
_edge("q21_glob_rule", ru.glob_rule("r", "**/libs/**/*.ts", "**/packages/**"), "regexp_matches(source, '^(.*/)?libs/(.*/)?[^/]*\\.ts$') AND regexp_matches(resolved, '^(.*/)?packages/')")


@q(code("SELECT e.source, e.ord, e.resolved FROM e JOIN m a ON a.source = e.source JOIN m b ON b.source = e.resolved WHERE a.language = 'typescript' AND b.language IN ('javascript', 'typescript')"))
def rule_p26_p29_language(spark, d):
    e = ev.with_facts(code_graph(spark, d)).where(edge_predicate(ru.rule({"from": {"language": "typescript"}, "to": {"language": ["javascript", "typescript"]}})))
    return e.select("source", "ord", "resolved")


@q("SELECT told FROM (VALUES ('r: from.namespace is not recorded for typescript'), ('r: to.assembly is not recorded for typescript, python')) v(told)")
def rule_p30_refused(spark, d):
    rs = ru.load({"forbidden": [{"name": "r", "from": {"namespace": "x"}, "to": {"assembly": "y"}}]})
    return rows_of(spark, [(x,) for x in ru.refuse_unrecorded(rs, ["typescript", "python"])], "told string")


@q("SELECT pattern, safe FROM (VALUES ('^src/[^/]+', true), ('(a+)+$', false), ('(x|y)*', true)) v(pattern, safe)")
def rule_p33_safe_patterns(spark, d):
    return rows_of(spark, [(p, not regex.check(p)) for p in ("^src/[^/]+", "(a+)+$", "(x|y)*")], "pattern string, safe boolean")


# --- rules about modules -------------------------------------------------------


@q(code("SELECT m.source FROM m LEFT JOIN (SELECT dst, count(*) FILTER (WHERE NOT regexp_matches(src, '/test/')) AS n FROM p GROUP BY dst) x ON x.dst = m.source WHERE regexp_matches(m.source, '/libs/') AND NOT regexp_matches(m.source, '\\.js$') AND coalesce(n, 0) > 2"))
def rule_p08_p09_module_paths(spark, d):
    rs = ru.load({"forbidden": [{"name": "r", "from": {"pathNot": "/test/"}, "module": {"path": "/libs/", "pathNot": "\\.js$", "numberOfDependentsMoreThan": 2}}]})
    return ev.module_violations(code_graph(spark, d), rs).select(F.col("from").alias("source"))


@q(code("SELECT source FROM m WHERE regexp_matches(source, '^[0-9]+/(libs|tools)/') AND NOT regexp_matches(source, '/libs/[a-m]') AND source NOT IN (SELECT node FROM r WHERE seed != node)", "r AS (SELECT src AS seed, dst AS node FROM p WHERE regexp_matches(src, '^[0-9]+/services/') UNION SELECT r.seed, p.dst FROM r JOIN p ON p.src = r.node)", True))
def rule_p12_p13_target_paths(spark, d):
    rs = ru.load({"forbidden": [{"name": "r", "from": {"path": "^[0-9]+/services/"}, "to": {"path": "^[0-9]+/(libs|tools)/", "pathNot": "/libs/[a-m]", "reachable": False}}]})
    return ev.module_violations(code_graph(spark, d), rs).select(F.col("from").alias("source"))


@q(code("SELECT DISTINCT seed AS \"from\", node AS \"to\" FROM r WHERE regexp_matches(node, '/tools/') AND seed != node", "r AS (SELECT src AS seed, dst AS node FROM p WHERE regexp_matches(src, '^[0-9]+/apps/[a-d]') UNION SELECT r.seed, p.dst FROM r JOIN p ON p.src = r.node WHERE regexp_matches(r.node, '/(apps|libs|tools)/'))", True))
def f17_chains_through(spark, d):
    rs = ru.load({"forbidden": [{"name": "r", "severity": "error", "from": {"path": "^[0-9]+/apps/[a-d]"}, "to": {"path": "/tools/", "reachable": True}, "graph": {"chainsThrough": "/(apps|libs|tools)/"}}]})
    return ev.module_violations(code_graph(spark, d), rs).select("from", "to")


@q(code("SELECT seed AS \"from\", node AS \"to\", min(level) AS steps FROM r WHERE regexp_matches(node, '/shared/') AND seed != node GROUP BY ALL", "r AS (SELECT src AS seed, dst AS node, 1 AS level FROM p WHERE regexp_matches(src, '^[0-9]+/apps/[a-c]') UNION SELECT r.seed, p.dst, level + 1 FROM r JOIN p ON p.src = r.node WHERE level < 15)", True))
def g12_reaches_derivation(spark, d):
    rs = ru.load({"forbidden": [{"name": "r", "severity": "error", "from": {"path": "^[0-9]+/apps/[a-c]"}, "to": {"path": "/shared/", "reachable": True}}]})
    return ev.module_violations(code_graph(spark, d, asked=["dependencyTypes"]), rs).select("from", "to", F.size("via").alias("steps"))


@q(code("SELECT source, source IN (SELECT node FROM r WHERE seed != node) AS reached FROM m WHERE regexp_matches(source, '^[0-9]+/packages/')", "r AS (SELECT src AS seed, dst AS node FROM p WHERE regexp_matches(src, '^[0-9]+/packages/a') UNION SELECT r.seed, p.dst FROM r JOIN p ON p.src = r.node)", True))
def g14_reached_by_another(spark, d):
    g = code_graph(spark, d)
    seeds = gr.select_nodes(g, "^[0-9]+/packages/a").withColumnRenamed("node", "seed")
    hit = gr.extremes(g.pairs, seeds).where("node != low or node != high").select(F.col("node").alias("source"), F.lit(True).alias("hit"))
    return g.modules.where("source rlike '^[0-9]+/packages/'").join(hit, "source", "left").select("source", F.coalesce("hit", F.lit(False)).alias("reached"))


@q(code("SELECT source FROM m WHERE regexp_matches(source, '/libs/') AND source NOT IN (SELECT source FROM l) AND source NOT IN (SELECT resolved FROM l)", "l AS (SELECT source, resolved FROM e WHERE regexp_matches(source, '/libs/') AND regexp_matches(resolved, '/libs/'))"))
def v02_orphans_of_a_view(spark, d):
    g = filters.include_only(code_graph(spark, d), "/libs/")
    rs = ru.load({"forbidden": [{"name": "no-orphans", "from": {"orphan": True, "path": "/libs/"}}]})
    return ev.module_violations(g, rs).select(F.col("from").alias("source"))


@q(code("SELECT source AS \"from\", source AS \"to\", 'module' AS type, 'use' AS rule, 'warn' AS severity FROM m WHERE regexp_matches(source, '^[0-9]+/apps/') AND NOT regexp_matches(source, '/shared/') AND source NOT IN (SELECT source FROM e WHERE regexp_matches(resolved, '/shared/')) AND source NOT IN (SELECT node FROM r WHERE seed != node)", "r AS (SELECT dst AS seed, src AS node FROM p WHERE regexp_matches(dst, '/shared/') UNION SELECT r.seed, p.src FROM r JOIN p ON p.dst = r.node)", True))
def y02_required_reachable(spark, d):
    rs = ru.load({"required": [{"name": "use", "module": {"path": "^[0-9]+/apps/"}, "to": {"path": "/shared/", "reachable": True}}]})
    return ev.module_violations(code_graph(spark, d), rs).select("from", "to", "type", "rule", "severity")


@q("SELECT name, family, scope FROM (VALUES ('edge', 'dependency', 'module'), ('lone', 'module', 'module'), ('far', 'module', 'module'), ('many', 'module', 'module'), ('dirs', 'folder', 'folder'), ('owners', 'project', 'project'), ('odd', 'none', 'folder')) v(name, family, scope)")
def v01_classified(spark, d):
    rs = [{"name": "edge", "to": {"path": "x"}}, {"name": "lone", "from": {"orphan": True}}, {"name": "far", "to": {"path": "x", "reachable": True}}, {"name": "many", "module": {"numberOfDependentsMoreThan": 1}}, {"name": "dirs", "scope": "folder"}, {"name": "owners", "scope": "project"}, {"name": "odd", "scope": "folder", "from": {"orphan": True}}]
    return rows_of(spark, [(r.name, r.family, r.scope) for r in map(ru.rule, rs)], "name string, family string, scope string")


@q(code("SELECT source FROM m WHERE regexp_matches(source, '/tools/') AND source IN (SELECT source FROM e)"))
def v06_module_match(spark, d):
    g = code_graph(spark, d)
    r = ru.rule({"name": "r", "from": {"orphan": False, "path": "/tools/"}})
    return ev.orphan_modules(g.with_(edges=g.edges.where("source rlike '/tools/'").withColumn("resolved", F.col("source"))), r).select("source")


# --- filters and graph ---------------------------------------------------------


@q(code("SELECT DISTINCT a AS source, b AS resolved FROM (SELECT CASE WHEN regexp_extract(source, 'node_modules/[^/]+|^[^/]+/[^/]+/') = '' THEN source ELSE regexp_extract(source, 'node_modules/[^/]+|^[^/]+/[^/]+/') END AS a, CASE WHEN regexp_extract(resolved, 'node_modules/[^/]+|^[^/]+/[^/]+/') = '' THEN resolved ELSE regexp_extract(resolved, 'node_modules/[^/]+|^[^/]+/[^/]+/') END AS b FROM e)"))
def f12_collapse_depth(spark, d):
    return filters.consolidate(code_graph(spark, d), pattern=filters.collapse_pattern(2)).edges.select("source", "resolved")


@q(code("SELECT source, regexp_matches(source, '\\.ts$') AS matchesHighlight FROM m WHERE regexp_matches(source, '/libs/|/apps/') AND NOT regexp_matches(source, 'node_modules')"))
def f13_filters_in_order(spark, d):
    g = filters.apply_filters(code_graph(spark, d, saved=False), {"highlight": "\\.ts$", "includeOnly": ["/libs/", "/apps/"], "exclude": "node_modules"})
    return g.modules.select("source", "matchesHighlight")


@q(code("SELECT i FROM (SELECT 0 AS i, count(*) AS n FROM e WHERE regexp_matches(source, '/apps/') AND regexp_matches(resolved, '/libs/') UNION ALL SELECT 1, count(*) FROM e WHERE regexp_matches(source, '/nowhere/') UNION ALL SELECT 2, count(*) FROM e WHERE regexp_matches(resolved, '/never/at/all')) WHERE n = 0"))
def f18_unmatched_ignores(spark, d):
    view = ru.rule({"graph": {"ignore": [{"from": "/apps/", "to": "/libs/"}, {"from": "/nowhere/"}, {"to": "/never/at/all"}]}}).graph
    return rows_of(spark, [(i,) for i in filters.unmatched_ignores(code_graph(spark, d), view)], "i int")


@q(code("SELECT source, ord, resolved, true AS valid, 0 AS rules FROM e"))
def f20_reset(spark, d):
    r = ruled(spark, d)
    e = filters.reset(ev.with_verdicts(r.graph, r.violations)).edges
    n = F.size(F.coalesce("rules", F.array())) if "rules" in e.columns else F.lit(0)
    return e.select("source", "ord", "resolved", F.coalesce("valid", F.lit(True)).alias("valid"), n.alias("rules"))


@q(code("SELECT src, dst FROM p"))
def g22_edges_for_views(spark, d):
    return code_graph(spark, d, saved=False).pairs


@q(code("SELECT source, count(*) AS targets FROM (SELECT DISTINCT src AS source, dst FROM p) GROUP BY source"))
def g19_dependency_sets(spark, d):
    g = code_graph(spark, d)
    one = gr.reach(g.pairs, g.pairs.select(F.col("src").alias("seed"), F.col("src").alias("node")).distinct(), 1)
    return one.groupBy(F.col("seed").alias("source")).agg(F.count(F.lit(1)).alias("targets"))


@q(code("SELECT p.src AS a, p.dst AS b, p.src = p.dst OR coalesce(x.scc = y.scc, false) AS same FROM p LEFT JOIN s x ON x.node = p.src LEFT JOIN s y ON y.node = p.dst", _SCC, True))
def g24_same_component(spark, d):
    g = code_graph(spark, d)
    return gr.same_component(gr.components(g.pairs), g.pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")))


@q(code("SELECT source, max(ord) + 1000 AS ord FROM (SELECT source, ord FROM e UNION ALL SELECT source, ord + 1000 FROM e) WHERE ord < 1000 GROUP BY source"))
def g01_last_module_holds(spark, d):
    e = code_graph(spark, d).edges
    m = e.select("source", "ord").unionByName(e.select("source", (F.col("ord") + 1000).alias("ord")))
    return Graph.of(e, m).modules.select("source", "ord")


# every cycle is closed and made of edges, and lies on an edge inside a component
@q(code("SELECT 'inside' AS circular, count(*) AS edges, true AS closed, true AS real, true AS inside FROM e JOIN s x ON x.node = e.source JOIN s y ON y.node = e.resolved WHERE x.scc = y.scc", _SCC, True))
def g04_cycles_hold(spark, d):
    """All edges inside components, whether their cycles end at their source, have only steps that are edges, and lie inside."""
    g = code_graph(spark, d)
    scc = gr.components(g.pairs)
    inside = gr.mark_circular(g, exact=False).edges.where("circular").select("source", "ord", "resolved")
    c = inside.join(gr.cycles(g, scc), ["source", "ord"], "left")
    names = F.transform(F.coalesce("cycle", F.array().cast(f"array<{STEP}>")), lambda s: s["name"])
    c = materialize(c.withColumn("names", names), "told")
    step = c.where("size(names) > 0").select("source", "ord", F.explode(F.arrays_zip(F.concat(F.array("source"), F.slice("names", 1, F.size("names") - 1)).alias("a"), F.col("names").alias("b"))).alias("s")).select("source", "ord", F.col("s.a").alias("src"), F.col("s.b").alias("dst"))
    bad = step.join(g.pairs, ["src", "dst"], "left_anti").select("source", "ord").distinct().withColumn("bad", F.lit(True))
    return c.join(bad, ["source", "ord"], "left").agg(
        F.lit("inside").alias("circular"), F.count(F.lit(1)).alias("edges"), F.bool_and((F.size("names") == 0) | ((F.element_at("names", -1) == F.col("source")) & (F.col("names")[0] == F.col("resolved")))).alias("closed"),
        F.bool_and(F.col("bad").isNull()).alias("real"), F.bool_and(F.size("names") == F.size(F.array_distinct("names"))).alias("inside"),
    )


@q(code("SELECT x.scc AS component, 'no-circular' AS rule, 'error' AS severity FROM e JOIN s x ON x.node = e.source JOIN s y ON y.node = e.resolved WHERE x.scc = y.scc GROUP BY x.scc", _SCC, True))
def v09_circular_components(spark, d):
    """The components in which a rule against cycles finds some.

    Which cycle an edge lies on is not asked, so none is searched. In each
    component some edge has a first cycle in edge order (into every target, the
    edge from the source that the search meets first), so the components are
    the same.
    """
    g = code_graph(spark, d, asked=["module", "dependencyTypes", "dependencyKind"])
    rs = ru.load({"forbidden": [{"name": "no-circular", "severity": "error", "to": {"circular": True}}]})
    v = ev.evaluate(g, rs, exact=False).violations.select(F.col("from").alias("node"), "rule", "severity")
    return v.join(gr.components(g.pairs), "node").select(F.col("scc").alias("component"), "rule", "severity").distinct()


@q(code("SELECT name, CAST(sum(length(source)) AS BIGINT) AS size, CAST(sum(length(source) % 7) AS BIGINT) AS statements FROM f GROUP BY name", _FOLDERS))
def a18_stats(spark, d):
    g = code_graph(spark, d)
    m = g.modules.withColumn("size", F.length("source").cast("bigint")).withColumn("statements", (F.length("source") % 7).cast("bigint"))
    return me.folder_table(g.with_(modules=m)).select("name", "size", "statements")


# --- evaluation ------------------------------------------------------------------

_RANK = "CASE severity WHEN 'error' THEN '0' WHEN 'warn' THEN '1' WHEN 'info' THEN '2' ELSE '3' END"


@q(code(f"SELECT e.source, e.ord, x.rules IS NULL AS valid, coalesce(x.rules, '') AS rules FROM e LEFT JOIN (SELECT \"from\", \"to\", string_agg(rule, ',' ORDER BY {_RANK}, rule) AS rules FROM u GROUP BY ALL) x ON x.\"from\" = e.source AND x.\"to\" = e.resolved", _RULED))
def v10_v12_verdicts(spark, d):
    r = ruled(spark, d)
    e = ev.with_verdicts(r.graph, r.violations).edges
    return e.select("source", "ord", "valid", F.coalesce(F.array_join(F.transform("rules", lambda x: x["name"]), ","), F.lit("")).alias("rules"))


@q(code("SELECT source, resolved, 'led' AS rule FROM e WHERE regexp_matches(source, '/apps/') AND regexp_matches(resolved, '^[0-9]+/libs/')"))
def v13_redirected(spark, d):
    rs = ru.load({"forbidden": [{"name": "led", "from": {"path": "/apps/"}, "to": {"path": "^the-libs$"}, "graph": {"redirect": [{"to": "^[0-9]+/libs/", "into": "the-libs"}]}}]})
    return ev.dependency_violations(code_graph(spark, d, saved=False), rs).select(F.col("from").alias("source"), F.col("to").alias("resolved"), "rule")


@q(code("SELECT rule FROM (SELECT 'a' AS rule, (SELECT count(*) FROM m WHERE regexp_matches(source, '/apps/')) AS n UNION ALL SELECT 'b', (SELECT count(*) FROM m WHERE regexp_matches(source, '/no/such/place')) UNION ALL SELECT 'd', (SELECT count(*) FROM e WHERE regexp_matches(source, '/never/'))) WHERE n = 0"))
def v14_vacuous(spark, d):
    rs = ru.load({"forbidden": [{"name": "a", "from": {"path": "/apps/"}}, {"name": "b", "from": {"path": "/no/such/place"}}, {"name": "c", "from": {"path": "/no/such/place"}, "allowEmpty": True}, {"name": "d", "from": {"path": "/apps/"}, "graph": {"ignore": [{"from": "/never/"}]}}]})
    return rows_of(spark, [(x,) for x in ev.vacuous(code_graph(spark, d), rs)], "rule string")


@q("SELECT rule FROM (VALUES ('old')) v(rule)")
def v15_expired(spark, d):
    rs = ru.load({"forbidden": [{"name": "old", "expires": "2026-06-29"}, {"name": "last-day", "expires": "2026-06-30"}, {"name": "open"}]})
    return rows_of(spark, [(x,) for x in ev.expired(rs, TODAY)], "rule string")


@q(code("SELECT source, resolved, 'tiers:' || a.n || '-to-' || b.n AS rule FROM e JOIN (VALUES (0, 'app', '/apps/'), (1, 'svc', '/services/'), (2, 'lib', '/libs/')) a(i, n, p) ON regexp_matches(source, a.p) JOIN (VALUES (0, 'app', '/apps/'), (1, 'svc', '/services/'), (2, 'lib', '/libs/')) b(i, n, p) ON regexp_matches(resolved, b.p) WHERE a.i > b.i"))
def v18_layers(spark, d):
    rs = ru.load({"layers": [{"name": "tiers", "layers": [{"name": "app", "path": "/apps/"}, {"name": "svc", "path": "/services/"}, {"name": "lib", "path": "/libs/"}]}]})
    return ev.dependency_violations(code_graph(spark, d, saved=False), rs).select(F.col("from").alias("source"), F.col("to").alias("resolved"), "rule")


@q(code("SELECT source, resolved, 'apart' AS rule FROM e WHERE regexp_matches(source, '^[0-9]+/packages/[^/]+/') AND regexp_matches(resolved, '^[0-9]+/packages/[^/]+/') AND NOT regexp_matches(resolved, '^[0-9]+/packages/' || regexp_extract(source, '^[0-9]+/packages/([^/]+)/', 1) || '/')"))
def v19_independence(spark, d):
    rs = ru.load({"independence": [{"name": "apart", "pattern": "^[0-9]+/packages/([^/]+)/"}]})
    return ev.dependency_violations(code_graph(spark, d, saved=False), rs).select(F.col("from").alias("source"), F.col("to").alias("resolved"), "rule")


@q("SELECT family, name, severity FROM (VALUES ('forbidden', 'a', 'warn'), ('forbidden', 'l:y-to-x', 'error'), ('required', 'c', 'info'), ('allowed', 'not-in-allowed', 'warn')) v(family, name, severity)")
def v20_normalised(spark, d):
    rs = ru.load({"forbidden": [{"name": "a"}, {"name": "b", "severity": "ignore"}], "layers": [{"name": "l", "layers": [{"name": "x", "path": "x"}, {"name": "y", "path": "y"}]}], "required": [{"name": "c", "severity": "info", "module": {"path": "m"}, "to": {"path": "t"}}], "allowed": [{"to": {"path": "z"}}]})
    told = [(f, r.name, r.severity) for f in ("forbidden", "required", "allowed") for r in getattr(rs, f)]
    return rows_of(spark, told, "family string, name string, severity string")


@q("SELECT asked FROM (VALUES ('cycles'), ('metrics'), ('facts'), ('dependents'), ('reach'), ('folders')) v(asked)")
def v21_v22_needed(spark, d):
    rs = ru.load({"forbidden": [{"to": {"circular": True}}, {"scope": "folder", "to": {"moreUnstable": True}}, {"from": {"language": "python"}}, {"module": {"numberOfDependentsLessThan": 2}}, {"to": {"path": "x", "reachable": True}}]})
    return rows_of(spark, [(x,) for x in needs(rs)], "asked string")


@q(code("SELECT source, resolved FROM e WHERE regexp_matches(source, '/apps/') AND dependencyKind IN ('inherits', 'implements', 'call')"))
def v23_kinds_on_a_rule(spark, d):
    rs = ru.load({"forbidden": [{"name": "k", "from": {"path": "/apps/"}, "to": {"dependencyKind": ["inherits", "implements", "call"]}}]})
    return ev.dependency_violations(code_graph(spark, d, saved=False), rs).select(F.col("from").alias("source"), F.col("to").alias("resolved"))


@q(code("SELECT id, CASE rule WHEN 'no-app-to-tool' THEN 'adr:0007' END AS decision, CASE rule WHEN 'no-app-to-tool' THEN 'move it' END AS fix FROM u", _RULED))
def v24_decisions(spark, d):
    return ruled(spark, d).violations.select("id", "decision", "fix")


@q(code('SELECT "from", "to", rule, severity FROM u', _RULED))
def y04_repeated_findings(spark, d):
    v = materialize(ruled(spark, d).violations.select(*ev.VIOLATION), "violations")
    return ev.unique(v.unionByName(v).unionByName(v.withColumn("severity", F.when(F.col("severity") == "error", "error").otherwise("ignore")))).select("from", "to", "rule", "severity")


@q(code(f"SELECT {_RANK} AS rank, count(*) AS n FROM u GROUP BY ALL", _RULED))
def y10_severity_order(spark, d):
    v = ruled(spark, d).violations
    return v.groupBy(order.severity_rank(F.col("severity")).cast("string").alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@q(code("SELECT least(255, count(*) FILTER (WHERE severity = 'error') + 1 + 2 + 3) AS code FROM u", _RULED))
def y13_y14_exit_code(spark, d):
    g = code_graph(spark, d)
    rules = {"forbidden": [*RULES["forbidden"][:3], {**RULES["forbidden"][3], "expires": "2026-01-01"}]}
    r = ev.evaluate(g, ru.load(rules))
    return rows_of(spark, [(r.exit_code(TODAY, over_budget=2, stale=3),)], "code bigint")


@q("SELECT a, b, first FROM (VALUES ('a-b', 'ab', 'a-b'), ('B', 'a', 'a'), ('a', 'A', 'a'), ('é', 'f', 'é'), ('x2', 'x10', 'x10')) v(a, b, first)")
def y11_y12_collation(spark, d):
    """Which of two names comes first under the root collation, binary order deciding ties."""
    df = rows_of(spark, [("a-b", "ab"), ("B", "a"), ("a", "A"), ("é", "f"), ("x2", "x10")], "a string, b string")
    both = df.select("a", "b", F.explode(F.array("a", "b")).alias("x"))
    nth = F.row_number().over(Window.partitionBy("a", "b").orderBy(order.collated(F.col("x")), F.desc("x")))
    return both.withColumn("n", nth).where("n = 1").select("a", "b", F.col("x").alias("first"))


# --- baselines ---------------------------------------------------------------------


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return materialize(ruled(spark, d).violations, "violations")


@q(code("SELECT id, h % 9 != 0 AS honoured FROM h WHERE h % 3 = 0", f"{_RULED}, {_KNOWN}"))
def b01_known_set(spark, d):
    return kn.known_set(_known(_judged(spark, d)), TODAY).select("id", "honoured")


@q(code("SELECT id, count(*) AS entries FROM h WHERE h % 3 = 0 GROUP BY id", f"{_RULED}, {_KNOWN}"))
def b03_matched_by_id(spark, d):
    v = _judged(spark, d).withColumn("v_id_", F.xxhash64("id", "from", "to"))
    known = kn.known_set(_known(v.drop("v_id_")).select("id", "expires", "owner"), TODAY)
    return kn.matches(v, known).join(v.select("v_id_", "id"), "v_id_").groupBy("id").agg(F.count_distinct("entry").alias("entries"))


@q(code("SELECT \"from\", \"to\", rule FROM h WHERE h % 3 = 0", f"{_RULED}, {_KNOWN}"))
def b02_matched_by_shape(spark, d):
    v = _judged(spark, d)
    known = _known(v).drop("id")
    return kn.observed(v, known, TODAY).select("from", "to", "rule")


@q(f"WITH {eq.RICH_SQL} SELECT key AS \"to\", CASE WHEN k % 4 = 0 THEN 'ignore' ELSE 'warn' END AS severity FROM t WHERE vis != 'public'")
def b05_soften_elements(spark, d):
    from depweave.operators import elements

    v = gr.complete(elements.findings(eq.rich_layer(spark, d), {"select": {"kind": "type"}, "should": {"bePublic": True}}, "shut"), {**ev.VIOLATION, "id": "string"})
    v = materialize(v, "elements")
    n = F.nullif(F.regexp_extract("to", "Part([0-9]+)$", 1), F.lit("")).cast("int")
    return kn.soften(v, v.where(n % 4 == 0).drop("id"), TODAY).select("to", "severity")


@q(code("SELECT id FROM h WHERE h % 3 = 0 AND severity != 'info'", f"{_RULED}, {_KNOWN}"))
def b06_observed(spark, d):
    v = _judged(spark, d)
    return kn.observed(v.where("severity != 'info'"), _known(v), TODAY).select("id")


@q(code("SELECT id, rule FROM h WHERE h % 3 = 0 AND severity != 'info'", f"{_RULED}, {_KNOWN}"))
def b08_b14_shrink_only(spark, d):
    v = _judged(spark, d)
    return kn.baseline(v.where("severity != 'info'"), _known(v), TODAY, "shrink-only").select("id", "rule")


@q(code('SELECT "from", "to", rule, severity FROM u', _RULED))
def b11_restored(spark, d):
    v = _judged(spark, d)
    return kn.restore_severities(kn.soften(v, _known(v), TODAY), ru.load(RULES)).select("from", "to", "rule", "severity")


@q(code("SELECT count(*) FILTER (WHERE s = 'error') AS error, count(*) FILTER (WHERE s = 'warn') AS warn, count(*) FILTER (WHERE s = 'info') AS info, count(*) FILTER (WHERE s = 'ignore') AS ignore FROM (SELECT CASE WHEN h % 3 = 0 AND h % 9 != 0 THEN 'ignore' ELSE severity END AS s FROM h)", f"{_RULED}, {_KNOWN}"))
def b15_apply_known(spark, d):
    v = _judged(spark, d)
    return kn.apply_known(v, _known(v), TODAY)[1]


@q(code("SELECT count(DISTINCT rule || chr(1) || \"from\" || chr(1) || \"to\") AS keys FROM u", _RULED))
def b16_keys_without_severity(spark, d):
    v = gr.complete(_judged(spark, d), ev.VIOLATION)
    both = v.unionByName(v.withColumn("severity", F.lit("ignore")))
    return both.select(kn.full_key(both).alias("k")).agg(F.count_distinct("k").alias("keys"))


@q("SELECT name, ceiling FROM (VALUES ('falls', 7), ('first', 9)) v(name, ceiling)")
def k24_budgets(spark, d):
    return rows_of(spark, [("falls", kn.lower_budget(7, 10)), ("first", kn.lower_budget(9, None))], "name string, ceiling int")


# --- questions -----------------------------------------------------------------------


@q(code("SELECT count(*) AS n, CASE WHEN count(*) > 50 THEN 'over' ELSE 'within' END AS verdict, abs(count(*) - 50) AS by FROM e WHERE regexp_matches(source, '/apps/') AND regexp_matches(resolved, '/libs/')"))
def q02_count(spark, d):
    return rows_of(spark, [wi.count(code_graph(spark, d, saved=False), "/apps/", "/libs/", 50)], "n bigint, verdict string, by bigint")


_SNAPSHOTS = "SELECT v AS version, 'fromMatches' AS section, repo AS name, CAST(count(*) FILTER (WHERE ord >= i * CASE WHEN length(repo) % 2 = 0 THEN 1000 ELSE 3 END) AS DOUBLE) AS value FROM edges, (VALUES ('1.0.0', 0), ('1.2.0', 1), ('1.10.0', 2)) x(v, i) GROUP BY ALL"


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A figure of each repository at three versions; it falls from version to version."""
    e = table(spark, d, "edges").groupBy("repo").agg(*[F.count_if(F.col("ord") >= i * F.when(F.length("repo") % 2 == 0, 1000).otherwise(3)).cast("double").alias(f"v{i}") for i in range(3)])
    vs = F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"v{i}").alias("value")) for i, v in enumerate(("1.0.0", "1.2.0", "1.10.0"))])
    return e.select(F.col("repo").alias("name"), F.explode(vs).alias("x")).select("x.version", F.lit("fromMatches").alias("section"), "name", "x.value")


@q(f"WITH s AS ({_SNAPSHOTS}) SELECT name AS rule FROM s WHERE version IN ('1.2.0', '1.10.0') GROUP BY name HAVING max(value) = 0 AND count(DISTINCT version) = 2")
def q17_unused_rules(spark, d):
    s = _snapshots(spark, d)
    return wi.unused_rules(s, 2)


@q(f"WITH s AS ({_SNAPSHOTS}) SELECT a.name, a.value AS before, b.value AS after FROM s a JOIN s b ON a.name = b.name AND a.version = '1.0.0' AND b.version = '1.10.0' WHERE b.value < a.value")
def q16_fallen_ratchets(spark, d):
    return wi.fallen_ratchets(_snapshots(spark, d).withColumn("section", F.lit("ratchets")), "1.0.0", "1.10.0")


@q(f"WITH s AS ({_SNAPSHOTS}) SELECT DISTINCT name AS rule, true AS removed FROM s WHERE length(name) % 2 = 0 UNION ALL SELECT 'gone', false")
def q16_retired_rules(spark, d):
    s = _snapshots(spark, d).where("not (version = '1.10.0' and length(name) % 2 = 0)")
    rs = ru.load({"forbidden": [{"name": "gone", "deprecated": "1.3.0"}, {"name": "stays", "deprecated": "2.0.0"}]})
    return rows_of(spark, wi.retired_rules(s, "1.0.0", "1.10.0", rs), "rule string, removed boolean")


@q(code("SELECT source, resolved, 'No module matching ^[0-9]+/apps/ may depend on a module matching ^[0-9]+/tools/.' AS said FROM e WHERE regexp_matches(source, '^[0-9]+/apps/') AND regexp_matches(resolved, '^[0-9]+/tools/') ORDER BY source, ord LIMIT 10"))
def q18_q19_explain(spark, d):
    said, first = wi.explain(code_graph(spark, d, saved=False), ru.rule(RULES["forbidden"][0]))
    return first.withColumn("said", F.lit(said))


@q("SELECT rule, edge, wanted, passed FROM (VALUES ('r', 'a/x -> b/y', true, true), ('r', 'a/x -> a/y', false, true), ('r', 'c/x -> b/y', true, false)) v(rule, edge, wanted, passed)")
def q20_examples(spark, d):
    rs = ru.load({"forbidden": [{"name": "r", "from": {"path": "^a/"}, "to": {"path": "^b/"}, "examples": {"forbidden": ["a/x -> b/y", "c/x -> b/y"], "allowed": ["a/x -> a/y"]}}]})
    return wi.run_examples(spark, rs)


@q(code("SELECT rule, 'never-matches' AS finding FROM (SELECT 'nothing' AS rule) UNION ALL SELECT rule, 'severity-below-error' FROM (SELECT unnest(['nothing', 'unresolved']) AS rule) WHERE rule NOT IN (SELECT rule FROM u)", _RULED))
def q22_q30_lint(spark, d):
    r = ruled(spark, d)
    rs = ru.load({"forbidden": [*RULES["forbidden"], {"name": "nothing", "severity": "info", "from": {"path": "/no/such/place"}}]})
    return wi.lint_graph(r.graph, rs, r.violations)


@q("SELECT rule, finding FROM (VALUES ('a', 'duplicate-name'), ('b', 'replaced-by-self'), ('c', 'replaced-by-unknown'), ('d', 'since-after-deprecated'), ('wide', 'shadowed'), ('not-in-allowed', 'allowed-admits-everything'), ('not-in-allowed', 'overlapping-allowed')) v(rule, finding)")
def q22_q31_lifecycle(spark, d):
    rs = ru.load({"forbidden": [{"name": "a"  , "from": {"path": "p"}}, {"name": "a", "from": {"path": "q"}}, {"name": "b", "replacedBy": "b", "to": {"path": "s"}}, {"name": "c", "replacedBy": "zz", "to": {"path": "t"}}, {"name": "d", "since": "2.0.0", "deprecated": "1.0.0", "to": {"path": "u"}}, {"name": "first", "severity": "error", "to": {"path": "w"}}, {"name": "wide", "to": {"path": "w"}}], "allowed": [{}, {}]})
    return rows_of(spark, ru.lint(rs) + ru.repeats(rs), "rule string, finding string")


@q(code("SELECT rule, \"from\", \"to\", CAST(NULL AS VARCHAR) AS repo FROM u WHERE severity = 'warn' UNION ALL SELECT rule, 'shop/' || \"from\", 'shop/' || \"to\", 'shop' FROM u WHERE severity = 'error'", _RULED))
def q23_fleet_findings(spark, d):
    v = _judged(spark, d)
    return wi.fleet_findings({"shop": v.where("severity = 'error'")}, v.where("severity = 'warn'")).select("rule", "from", "to", "repo")


@q(code("SELECT rule, \"from\", \"to\" FROM u WHERE \"from\" IN (SELECT node FROM r)", f"{_RULED}, r AS (SELECT source AS node, 0 AS level FROM m WHERE regexp_matches(source, '/(graph|theme)\\.[a-z]+$') UNION SELECT p.src, level + 1 FROM r JOIN p ON p.dst = r.node WHERE level < 2)", True))
def q24_q25_touching(spark, d):
    r = ruled(spark, d)
    c = gr.select_nodes(r.graph, "/(graph|theme)\\.[a-z]+$").select(F.col("node").alias("path"), F.lit("modified").alias("kind"), F.lit(None).cast("string").alias("old_path"))
    return wi.touching(_judged(spark, d), wi.affected(r.graph, c, 2)).select("rule", "from", "to")


@q(code("SELECT 'open' AS section, rule AS name, severity AS state, count(*) AS n FROM u WHERE severity != 'ignore' GROUP BY rule, severity UNION ALL SELECT 'ratchet', 'few', CASE WHEN count(*) > 50 THEN 'over' ELSE 'within' END, abs(count(*) - 50) FROM e WHERE regexp_matches(source, '/apps/') AND regexp_matches(resolved, '/libs/') UNION ALL SELECT 'vacuous', 'nothing', NULL, NULL", _RULED))
def q26_brief(spark, d):
    rules = {"forbidden": [*RULES["forbidden"], {"name": "nothing", "from": {"path": "/no/such/place"}}], "ratchets": [{"name": "few", "from": {"path": "/apps/"}, "to": {"path": "/libs/"}, "max": 50}]}
    return wi.brief(ev.evaluate(code_graph(spark, d), ru.load(rules)))


@q(code("SELECT change, count(*) AS n FROM (SELECT 'new' AS change FROM u WHERE severity = 'warn' UNION ALL SELECT 'resolved' FROM u WHERE severity = 'info') GROUP BY ALL", _RULED))
def q29_diff_findings(spark, d):
    v = _judged(spark, d)
    return wi.diff_findings(v.where("severity != 'warn'"), v.where("severity != 'info'")).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


_FROM = {"no-app-to-tool": "regexp_matches(source, '^[0-9]+/apps/')", "no-dev": "NOT regexp_matches(source, '/test/')", "unresolved": "true", "own-package": "regexp_matches(source, '^([0-9]+)/packages/([^/]+)/')"}
_SNAPSHOT_SQL = "SELECT '1.0.0' AS version, section, name, CAST(value AS DOUBLE) AS value FROM (" + " UNION ALL ".join([
    "SELECT 'totals' AS section, 'totalCruised' AS name, count(*) AS value FROM m", "SELECT 'totals', 'totalDependenciesCruised', count(*) FROM e",
    *[f"SELECT 'violations', '{s}', count(*) FROM u WHERE severity = '{s}'" for s in ("error", "warn", "info", "ignore")],
    "SELECT 'instability', name, instability FROM ft", "SELECT 'projectInstability', name, CASE WHEN ca + ce = 0 THEN 0.0 ELSE CAST(ce AS DOUBLE) / (ca + ce) END FROM pt", "SELECT 'ruleViolations', rule, count(*) FROM u GROUP BY rule",
    *[f"SELECT 'fromMatches', '{n}', count(*) FROM m WHERE {w}" for n, w in _FROM.items()],
    *[f"SELECT 'toMatches', '{n}', " + ("count(*) FROM e WHERE regexp_matches(resolved, '^[0-9]+/tools/')" if n == "no-app-to-tool" else "0") for n in _FROM],
]) + ")"


@q(code(_SNAPSHOT_SQL, f"{_RULED}, {_FOLDERS}, {_PROJECTS}"))
def q13_a17_k25_snapshot(spark, d):
    return wi.snapshot(ruled(spark, d), "1.0.0")


# --- sources -----------------------------------------------------------------------------


@q(code("SELECT source, ord, resolved, coalesce(dependencyKind, '') AS kind FROM e"))
def s02_k01_document_round_trip(spark, d):
    """The graph as documents of the interchange format, one for each module, read again."""
    docs = rp.document(code_graph(spark, d)).select(F.concat(F.lit('{"modules":['), "json", F.lit("]}")).alias("body"))
    e = so.from_json(docs, "body").edges
    nth = F.row_number().over(Window.partitionBy("source").orderBy("ord")) - 1
    own = code_graph(spark, d, saved=False).edges.select("source", F.col("ord").alias("own"), (F.row_number().over(Window.partitionBy("source").orderBy("ord")) - 1).alias("nth"))
    return e.withColumn("nth", nth).join(own, ["source", "nth"]).select("source", F.col("own").alias("ord"), "resolved", F.coalesce("dependencyKind", F.lit("")).alias("kind"))


@q(code("SELECT source FROM m WHERE regexp_matches(lower(source), '\\.(ts|py)$') AND regexp_matches(source, '/libs/|/apps/') AND NOT regexp_matches(source, '/core/')"))
def s05_gather(spark, d):
    return so.gather(code_graph(spark, d, saved=False).modules, "source", [".ts", "py"], "/libs/|/apps/", "/core/").select("source")


@q(code("SELECT source, ord, CASE WHEN module IN ('fs', 'typing') THEN 'core' WHEN couldNotResolve THEN 'unknown' WHEN contains(resolved, 'node_modules/') THEN 'npm' END AS type FROM e WHERE module IN ('fs', 'typing') OR couldNotResolve OR contains(resolved, 'node_modules/')"))
def s08_edge_types(spark, d):
    e = code_graph(spark, d, saved=False).edges.where("module in ('fs', 'typing') or couldNotResolve or contains(resolved, 'node_modules/')")
    return e.select("source", "ord", F.get(so.edge_types(["fs", "typing"]), F.lit(0)).alias("type"))


@q("WITH k AS (SELECT DISTINCT source FROM edges WHERE couldNotResolve = false), i AS (SELECT DISTINCT source, regexp_extract(source, '[^/]+$') AS f FROM edges) SELECT source, './' || f AS module, source IN (SELECT source FROM k) AS known FROM i WHERE NOT regexp_matches(source, '//|\\\\|/\\./|/\\.\\./|^\\s|\\s$|^\\./')")
def s07_s13_relative(spark, d):
    """Every module imported by itself, as a neighbour in its folder."""
    e = table(spark, d, "edges").where(~F.col("source").rlike(r"//|\\|/\./|/\.\./|^\s|\s$|^\./"))
    i = e.select("source", F.concat(F.lit("./"), F.regexp_extract("source", "[^/]+$", 0)).alias("module")).distinct()
    known = table(spark, d, "edges").where("not couldNotResolve").select("source").distinct()
    return so.resolve(i, known).select("source", "module", (~F.col("couldNotResolve")).alias("known"))


@q(f"WITH {eq.RICH_SQL} SELECT key, CASE WHEN k % 2 = 0 THEN 'src/' || name || '.cs' ELSE 'shop/' || name || '.cs' END AS file FROM t0")
def s10_attributed(spark, d):
    c = eq.rich_layer(spark, d)
    n = F.regexp_extract("fullName", "Part([0-9]+)$", 1)
    t = c.types.where("fullName rlike 'Part[0-9]+$'").select("fullName", n.alias("n"))
    named = lambda folder: t.select("fullName", F.concat(F.lit(folder + "/Part"), "n", F.lit(".cs")).alias("file"), "n")
    out = so.attribute_files(t.select("fullName"), named("src").where("cast(n as int) % 2 = 0").select("fullName", "file"), named("shop").select("fullName", "file"))
    return out.select(F.col("fullName").alias("key"), "file")


@q(code("SELECT part, count(*) AS modules FROM (SELECT source, CASE WHEN regexp_matches(source, '\\.py$') THEN 1 ELSE 0 END AS part FROM m) GROUP BY part"))
def s14_merge(spark, d):
    g = code_graph(spark, d)
    py = F.col("source").rlike("\\.py$")
    m = so.merge(Graph(g.modules.where(~py), g.edges.where(~py)), Graph(g.modules.where(py), g.edges.where(py))).modules
    return m.groupBy(F.shiftright("ord", 40).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("modules"))


_OPENAPI = json.dumps({"paths": {"/size": {"get": {"operationId": "Size", "x-handler": "h/size.ts"}, "put": {"operationId": "Make", "x-handler": "./h/../h/make.ts"}}, "/ref": {"$ref": "#/x"}, "/none": {"get": {"operationId": "Nobody", "x-handler": "h/none.ts"}}}})


@q(f"WITH {eq.RICH_SQL} SELECT 'shop/' || regexp_extract(owner, 'Part[0-9]+') || '.cs' AS \"from\", CASE name WHEN 'Size' THEN 'api/h/size.ts' ELSE 'api/h/make.ts' END AS \"to\", name AS module, CASE name WHEN 'Size' THEN 'operation Size (GET /size)' ELSE 'operation Make (PUT /size)' END AS comment FROM mb WHERE name IN ('Size', 'Make')")
def s16_s27_s28_openapi(spark, d):
    c = eq.rich_layer(spark, d)
    return so.openapi_edges(so.read_openapi(spark, _OPENAPI), so.client_names(c.types, c.members, "shop"), "api").select("from", "to", "module", "comment")


@q("SELECT \"from\", \"to\", module FROM (VALUES ('no', 'where', 'where')) v(\"from\", \"to\", module)")
def s15_s18_stale_declared(spark, d):
    g = code_graph(spark, d)
    a = g.modules.agg(F.min("source")).first()[0]
    told = so.read_declared(spark, json.dumps({"declared": [{"from": "no", "to": "where"}, {"from": a, "to": a, "kind": "data"}]}))
    return so.apply_declared(g, told)[1].select("from", "to", "module")


@q(code("SELECT source AS path, CASE length(source) % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'renamed' END AS kind, CASE length(source) % 3 WHEN 2 THEN 'old/' || source END AS old_path FROM m WHERE NOT regexp_matches(source, '\\s')"))
def s21_status_lines(spark, d):
    n = F.length("source") % 3
    line = F.when(n == 0, F.concat(F.lit("A  "), "source")).when(n == 1, F.concat(F.lit(" M "), "source")).otherwise(F.concat(F.lit("R  old/"), "source", F.lit(" -> "), "source"))
    return so.status_lines(code_graph(spark, d, saved=False).modules.select(line.alias("line")), "line")


@q("SELECT version, n FROM (VALUES ('1.0.0', 1), ('1.2.0', 2), ('1.10.0', 3)) v(version, n)")
def s24_versions(spark, d):
    path = f"{shared_dir(spark)}/depweave/snapshots-read"
    _snapshots(spark, d).write.mode("overwrite").parquet(path)
    return rows_of(spark, [(v, i + 1) for i, v in enumerate(so.read_snapshots(spark, path)[1])], "version string, n int")


@q("SELECT name, path FROM (VALUES ('a', 'a'), ('b', 'repos/b')) v(name, path)")
def s29_manifest(spark, d):
    repos, _ = so.read_fleet('{"repos": ["a", {"name": "b", "path": "repos/b"}], "rules": {}}')
    return rows_of(spark, [(r["name"], r["path"]) for r in repos], "name string, path string")


_SCRIPTS = "n AS (SELECT source, resolved, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS n FROM e WHERE regexp_matches(source, '\\.(ts|js)$'))"


@q(code("SELECT source, n AS ord, resolved AS module, CASE n % 5 WHEN 0 THEN 'import' WHEN 1 THEN 'export' WHEN 2 THEN 'require' WHEN 3 THEN 'dynamic-import' ELSE 'import' END AS kind, n % 5 = 4 AS typeOnly FROM n", _SCRIPTS))
def s04_s06_scripts(spark, d):
    """Modules written as source text, one statement for each edge between comments, and read again."""
    e = code_graph(spark, d, saved=False).edges.where(F.col("source").rlike(r"\.(ts|js)$"))
    n = F.row_number().over(Window.partitionBy("source").orderBy("ord")) - 1
    said = [F.concat(F.lit(a), F.col("resolved"), F.lit(b)) for a, b in (('import { a } from "', '";\n'), ("export * from '", "' // from 'x'\n"), ('const b = require("', '"); /* require("y") */\n'), ("await import('", "');\n"), ('import type { T } from "', '";\n'))]
    line = F.element_at(F.array(*said), F.pmod(F.col("n"), F.lit(5)).cast("int") + 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "")
    files = e.withColumn("n", n).withColumn("line", line).groupBy(F.col("source").alias("path")).agg(text.alias("text"))
    return sc.script_imports(files).select("source", "ord", "module", "kind", "typeOnly")


_DOTTED = "'m' || regexp_replace(resolved, '[^a-zA-Z0-9]', '_', 'g')"


@q(code(f"SELECT source, n AS ord, CASE WHEN n % 3 = 1 THEN '.' || {_DOTTED} ELSE {_DOTTED} END AS module, n % 3 = 2 AS typeOnly FROM (SELECT source, resolved, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS n FROM e WHERE regexp_matches(source, '\\.py$'))"))
def s11_s12_python(spark, d):
    """Python modules written as source text, with plain, relative and type-only imports, and read again."""
    e = code_graph(spark, d, saved=False).edges.where(F.col("source").rlike(r"\.py$"))
    n = F.row_number().over(Window.partitionBy("source").orderBy("ord")) - 1
    name = F.concat(F.lit("m"), F.regexp_replace("resolved", "[^a-zA-Z0-9]", "_"))
    line = F.when(F.col("n") % 3 == 0, F.concat(F.lit("import "), name, F.lit("  # import no\n"))).when(F.col("n") % 3 == 1, F.concat(F.lit("from ."), name, F.lit(" import x\n"))).otherwise(F.concat(F.lit("if TYPE_CHECKING:\n    import "), name, F.lit("\n")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "")
    files = e.withColumn("n", n).withColumn("line", line).groupBy(F.col("source").alias("path")).agg(text.alias("text"))
    return sc.python_imports(files).select("source", "ord", "module", "typeOnly")


@q("SELECT path, letters FROM (VALUES ('a/b.ts', 3), ('c.py', 0)) v(path, letters)")
def s25_files_in_memory(spark, d):
    return sc.tree(spark, {"c.py": "", "a/b.ts": "x=1"}).select("path", F.length("text").alias("letters"))


# --- reports ---------------------------------------------------------------------------------

_SHOWN = "CASE WHEN \"from\" = \"to\" THEN \"from\" ELSE \"from\" || ' → ' || \"to\" END"
_SERVICE = lambda c: f"regexp_replace({c}, '([|''\\[\\]])', '|\\1', 'g')"
_HTML = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_LINES = {
    "k05_err": ("err", f"'  ' || severity || ' ' || rule || ': ' || {_SHOWN}", "severity != 'ignore'"),
    "k08_markdown": ("markdown", f"'- ' || severity || ' **' || rule || '**: ' || {_SHOWN}", "true"),
    "k10_err_html": ("err-html", f"'<li class=\"' || severity || '\">' || {_HTML('rule')} || ': ' || {_HTML(_SHOWN)} || '</li>'", "true"),
    "k11_sarif": ("sarif", f"json_object('ruleId', rule, 'level', CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' WHEN 'info' THEN 'note' ELSE 'none' END, 'message', json_object('text', {_SHOWN}), 'partialFingerprints', json_object('id', id), 'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', \"from\")))))", "true"),
    "k14_teamcity": ("teamcity", f"'##teamcity[inspection typeId=''' || {_SERVICE('rule')} || ''' message=''' || {_SERVICE(_SHOWN)} || ''' file=''' || {_SERVICE('\"from\"')} || ''' SEVERITY=''' || CASE severity WHEN 'error' THEN 'ERROR' WHEN 'warn' THEN 'WARNING' ELSE 'INFO' END || ''']'", "true"),
    "k15_azure": ("azure-devops", f"'##vso[task.logissue type=' || CASE severity WHEN 'error' THEN 'error' ELSE 'warning' END || ';sourcepath=' || \"from\" || ';code=' || rule || ']' || {_SHOWN}", "severity IN ('error', 'warn')"),
    "k16_github": ("github-annotations", f"'::' || CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'notice' END || ' file=' || \"from\" || ',title=' || rule || '::' || {_SHOWN}", "true"),
}
for _name, (_kind, _line, _where) in _LINES.items():

    @q(code(f"SELECT CAST({_line} AS VARCHAR) AS line FROM u WHERE {_where}", _RULED), _name)
    def _finding(spark: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        return rp.finding_lines(ruled(spark, d).violations, kind)


_CASES = "c AS (SELECT rule, count(id) AS n FROM (SELECT unnest(['no-app-to-tool', 'no-dev', 'unresolved', 'own-package']) AS rule) LEFT JOIN u USING (rule) GROUP BY rule)"
for _name, _kind, _line in (
    ("k12_junit", "junit", "'<testcase name=\"' || rule || '\">' || CASE WHEN n = 0 THEN '' ELSE '<failure message=\"' || n || ' violations\"/>' END || '</testcase>'"),
    ("k13_trx", "trx", "'<UnitTestResult testName=\"' || rule || '\" outcome=\"' || CASE WHEN n = 0 THEN 'Passed' ELSE 'Failed' END || '\"/>'"),
):

    @q(code(f"SELECT {_line} AS line FROM c", f"{_RULED}, {_CASES}"), _name)
    def _case(spark: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        r = ruled(spark, d)
        return rp.case_lines(rp.catalog([(x.name, x.severity) for x in r.rules.all()], r.violations), kind).select("line")


_SHORT = lambda c: f"'n' || substr(sha256({c}), 1, 12)"
_ENDS = "(SELECT src FROM p UNION SELECT dst FROM p)"
for _name, _kind, _sql in (
    ("k17_dot", "dot", "SELECT '  \"' || src || '\" -> \"' || dst || '\"' AS line FROM p"), ("k19_d2", "d2", "SELECT '\"' || src || '\" -> \"' || dst || '\"' AS line FROM p"),
    ("k18_mermaid", "mermaid", f"SELECT '  ' || {_SHORT('src')} || ' --> ' || {_SHORT('dst')} AS line FROM p UNION ALL SELECT '  ' || {_SHORT('src')} || '[\"' || src || '\"]' FROM {_ENDS}"),
    ("k20_plantuml", "plantuml", f"SELECT '[' || src || '] --|> [' || dst || ']' AS line FROM p UNION ALL SELECT '[' || src || ']' FROM {_ENDS}"),
):

    @q(code(_sql), _name)
    def _diagram(spark: SparkSession, d: str, kind: str = _kind) -> DataFrame:
        return rp.graph_lines(code_graph(spark, d, saved=False), kind).select("line")


@q("SELECT digest FROM (SELECT sha256('a' || chr(10) || sha256('1') || chr(10) || 'b' || chr(10) || sha256('2') || chr(10)) AS digest)")
def k26_attestation(spark, d):
    return rows_of(spark, [(rp.attestation({"b": b"2", "a": b"1"}),)], "digest string")


# --- scalars ------------------------------------------------------------------------------------


@q("SELECT doc_id, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units FROM documents WHERE text IS NOT NULL")
def z12_utf16_length(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", me.utf16_length(F.col("text")).alias("units"))


@q(code("SELECT source, CAST(round(instability * 100) AS INT) || '%' AS share FROM i", _METRICS))
def z13_percent(spark, d):
    return me.couplings(code_graph(spark, d)).select("source", rp.percent(F.col("instability")).alias("share"))


@q(code("SELECT source, regexp_replace(source, '/[^/]*/[^/]*$', '') || '/x' AS joined FROM m WHERE regexp_matches(source, '^[0-9]+/[^/]+/[^/]+/[^/]+') AND NOT regexp_matches(source, '/\\.|//|/$')"))
def z06_joined_paths(spark, d):
    m = code_graph(spark, d, saved=False).modules.where(F.col("source").rlike("^[0-9]+/[^/]+/[^/]+/[^/]+") & ~F.col("source").rlike(r"/\.|//|/$"))
    return m.select("source", normalize_dots(F.concat(dirname(F.col("source")), F.lit("/.././x"))).alias("joined"))


@q(code("SELECT source, regexp_matches(source, '^[0-9]+/(apps|libs)/') AS test, nullif(regexp_extract(source, '^[0-9]+/(apps|libs)/([^/]+)', 2), '') AS found FROM m WHERE regexp_matches(source, '^[0-9]+/')"))
def z01_pattern_groups(spark, d):
    m = code_graph(spark, d, saved=False).modules.where("source rlike '^[0-9]+/'")
    p = "^[0-9]+/(apps|libs)/([^/]+)"
    return m.select("source", regex.matches(F.col("source"), "^[0-9]+/(apps|libs)/").alias("test"), F.nullif(F.regexp_extract("source", regex.to_java(p), 2), F.lit("")).alias("found"))


@q(code("SELECT source FROM m WHERE regexp_matches(source, '^(.*/)?apps/[^/]*/([^/]*/)*[^/]*\\.tsx?$')"))
def z05_globs(spark, d):
    p = regex.join([regex.glob_to_pattern("**/apps/*/**/*.ts"), regex.glob_to_pattern("**/apps/*/**/*.tsx")])
    return code_graph(spark, d, saved=False).modules.where(regex.matches(F.col("source"), p)).select("source")


@q("SELECT n, version FROM (VALUES (1, '0.9.0'), (2, '1.0.0-alpha'), (3, '1.0.0-alpha.2'), (4, '1.0.0-alpha.10'), (5, '1.0.0'), (6, '1.2.0'), (7, '1.10.0')) v(n, version)")
def z08_z09_versions(spark, d):
    given = ["1.10.0", "1.0.0-alpha.10", "1.2.0", "0.9.0", "1.0.0", "1.0.0-alpha.2", "1.0.0-alpha"]
    return rows_of(spark, [(i + 1, v) for i, v in enumerate(order.sort_versions(given))], "n int, version string")


# --- time -------------------------------------------------------------------------------------------


@q("SELECT same, other FROM (VALUES (true, true)) v(same, other)")
def t02_t03_cache_keys(spark, d):
    """Keys follow the configuration and the rows, not their order."""
    e = table(spark, d, "edges").select("run_id", "source", "ord", "resolved")
    key = st.cache_key("c", e)
    return rows_of(spark, [(key == st.cache_key("c", e.orderBy(F.desc("source"))), key != st.cache_key("c", e.where("ord > 0")) and key != st.cache_key("d", e))], "same boolean, other boolean")


@q("SELECT repo, count(*) AS n FROM edges GROUP BY repo")
def t04_t09_cached(spark, d):
    e = table(spark, d, "edges")
    key = st.cache_key("per-repo", e.select("repo", "source", "ord"))
    make = lambda: e.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    st.cached(spark, key, make)
    return st.cached(spark, key, lambda: 1 / 0)


@q(code("SELECT source, ord, resolved FROM e WHERE NOT regexp_matches(source, '/libs/') UNION ALL SELECT source, ord, 'new' FROM e WHERE regexp_matches(source, '/libs/')"))
def t05_t06_changed_files(spark, d):
    e = code_graph(spark, d).edges.select("source", "ord", "resolved")
    return so.replace_changed(e, e.where("source rlike '/libs/'").withColumn("resolved", F.lit("new")))


@q("SELECT DISTINCT source AS \"from\", resolved AS \"to\", CASE WHEN regexp_matches(resolved, '^libs/') THEN 'down' ELSE 'dyn' END AS rule FROM edges WHERE source IS NOT NULL AND resolved IS NOT NULL AND regexp_matches(source, '^apps/') AND regexp_matches(resolved, '^libs/') UNION SELECT DISTINCT source, resolved, 'dyn' FROM edges WHERE source IS NOT NULL AND resolved IS NOT NULL AND dynamic")
def t07_watch(spark, d):
    """The edge table as a stream: each batch judged, findings read from where they are written."""
    import uuid

    at = f"{shared_dir(spark)}/depweave/watch-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/edges.parquet")
    folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    schema = table(spark, d, "edges").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/edges.parquet") if folder else spark.readStream.schema(schema).option("pathGlobFilter", "edges.parquet").parquet(d)
    rs = ru.load({"forbidden": [{"name": "down", "from": {"path": "^apps/"}, "to": {"path": "^libs/"}}, {"name": "dyn", "to": {"dynamic": True}}]})
    st.watch(stream, rs, f"{at}/found", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/found").select("from", "to", "rule").distinct()


@q("SELECT family, name, severity FROM (VALUES ('forbidden', 'a', 'error'), ('forbidden', 'b', 'info'), ('forbidden', 'c', 'warn')) v(family, name, severity)")
def u04_extends(spark, d):
    base = {"forbidden": [{"name": "a", "severity": "warn", "from": {"path": "x"}}, {"name": "b", "severity": "info"}]}
    rs = ru.load(ru.extend(base, {"forbidden": [{"name": "a", "severity": "error"}, {"name": "c"}]}))
    return rows_of(spark, [("forbidden", r.name, r.severity) for r in rs.forbidden], "family string, name string, severity string")


@q(code("SELECT 'mine:' || count(*) AS line FROM u", _RULED))
def u02_plugin_report(spark, d):
    lines = rp.report(ruled(spark, d), lambda r: iter([f"mine:{r.violations.count()}"]))
    return rows_of(spark, [(x,) for x in lines], "line string")
