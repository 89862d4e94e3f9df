"""Queries over the dependency graph and its SQL counterparts, by the inventory's row ids."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.operators import diagrams, elements, evaluate as ev, filters, graph as gr, known as kn, metrics as me, shred, slices as sl, whatif as wi
from depweave.functions.paths import dirname, normalize_dots, parents
from depweave.plans import rules as ru
from depweave.plans.compile import edge_predicate, view_edges
from depweave.plans.data_queries import DOCUMENT_EDGES_SQL
from depweave.sinks import reports as rp
from depweave.sources import graphs as so
from depweave.sources.views import CODE_SQL, FK_SQL, LAYER_SQL, code_edges, code_graph, code_layer, fk_graph, table
from depweave.streaming import edges as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TODAY = date(2026, 6, 30)


def q(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL over the views ``e``, ``p`` and ``m`` where it has one."""

    def put(f: Query) -> Query:
        n = name or f.__name__
        QUERIES[n] = f
        if sql:
            SQL[n] = sql
        return f

    return put


def code(rest: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{CODE_SQL}{', ' + more if more else ''} {rest}"


# --- edge predicates ---------------------------------------------------------


def _edges(rule: dict, facts: bool = False, metrics: bool = False) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = code_graph(spark, d, saved=facts or metrics)
        if metrics:
            g = me.with_metrics(g)
        e = ev.with_facts(g) if facts or metrics else g.edges.withColumn("from_instability", F.lit(None).cast("double"))
        return e.where(edge_predicate(ru.rule(rule))).select("source", "ord", "resolved")

    return run


def _pred(name: str, rule: dict, where: str, facts: bool = False, joins: str = "") -> None:
    q(code(f"SELECT e.source, e.ord, e.resolved FROM e {joins} WHERE {where}"), name)(_edges(rule, facts))


_pred("edge_p06_p10_paths", {"from": {"path": "^[0-9]+/packages/"}, "to": {"path": "^[0-9]+/(apps|tools)/"}}, "regexp_matches(e.source, '^[0-9]+/packages/') AND regexp_matches(e.resolved, '^[0-9]+/(apps|tools)/')")
_pred("edge_p07_p11_paths_not", {"from": {"pathNot": ["^[0-9]+/src/", "\\.py$"]}, "to": {"pathNot": "node_modules|\\.ts$"}}, "NOT regexp_matches(e.source, '^[0-9]+/src/|\\.py$') AND NOT regexp_matches(e.resolved, 'node_modules|\\.ts$')")
_pred(
    "edge_p02_captures",
    {"from": {"path": "^([0-9]+)/packages/([^/]+)/"}, "to": {"path": "^$1/packages/", "pathNot": "^$1/packages/$2/"}},
    "regexp_matches(e.source, '^([0-9]+)/packages/([^/]+)/') AND starts_with(e.resolved, regexp_extract(e.source, '^([0-9]+)/packages/', 1) || '/packages/') AND NOT starts_with(e.resolved, regexp_extract(e.source, '^([0-9]+/packages/[^/]+/)', 1))",
)
_pred("edge_p14_types", {"to": {"dependencyTypes": ["npm-dev", "core"]}}, "list_has_any(e.dependencyTypes, ['npm-dev', 'core'])")
_pred("edge_p15_types_not", {"to": {"dependencyTypesNot": ["local", "npm"]}}, "NOT coalesce(list_has_any(e.dependencyTypes, ['local', 'npm']), false)")
_pred("edge_p21_more_than_one_type", {"to": {"moreThanOneDependencyType": True}}, "coalesce(len(list_filter(e.dependencyTypes, lambda t: coalesce(t IN ('core','local','localmodule','npm','npm-bundled','npm-dev','npm-no-pkg','npm-optional','npm-peer','npm-unknown'), false))), 0) > 1")
_pred("edge_p24_could_not_resolve", {"to": {"couldNotResolve": True}}, "e.couldNotResolve")
_pred("edge_p24_dynamic", {"from": {"path": "/src/"}, "to": {"dynamic": False}}, "regexp_matches(e.source, '/src/') AND NOT e.dynamic")
_pred("edge_p03_absent_is_not_false", {"to": {"preCompilationOnly": False}}, "false")
_pred("edge_p27_project_not", {"from": {"project": "/libs/"}, "to": {"projectNot": "/libs/"}}, "regexp_matches(a.project, '/libs/') AND b.project IS NOT NULL AND NOT regexp_matches(b.project, '/libs/')", True, "JOIN m a ON a.source = e.source JOIN m b ON b.source = e.resolved")
_pred("edge_p28_kind", {"to": {"dependencyKind": ["inherits", "implements"]}}, "e.dependencyKind IN ('inherits', 'implements')")
_pred("edge_p28_kind_not", {"to": {"dependencyKindNot": ["import"]}}, "e.dependencyKind IS NOT NULL AND e.dependencyKind != 'import'")
_METRICS = """ce AS (SELECT source, count(*) AS ce FROM e GROUP BY source), ca AS (SELECT dst AS source, count(*) AS ca FROM p GROUP BY dst),
 i AS (SELECT m.source, coalesce(ce, 0) AS ce, coalesce(ca, 0) AS ca, CASE WHEN coalesce(ce, 0) + coalesce(ca, 0) = 0 THEN 0.0 ELSE CAST(coalesce(ce, 0) AS DOUBLE) / (coalesce(ce, 0) + coalesce(ca, 0)) END AS instability
  FROM m LEFT JOIN ce USING (source) LEFT JOIN ca USING (source) WHERE calculable)"""
q(code("SELECT e.source, e.ord, e.resolved FROM e JOIN i a ON a.source = e.source LEFT JOIN i b ON b.source = e.resolved WHERE a.instability < coalesce(b.instability, 0.0)", _METRICS), "edge_p20_more_unstable")(_edges({"to": {"moreUnstable": True}}, metrics=True))

# --- filters -----------------------------------------------------------------


@q(code("SELECT source, ord, resolved FROM e WHERE NOT regexp_matches(source, 'node_modules|/tools/') AND NOT regexp_matches(resolved, 'node_modules|/tools/')"))
def f01_exclude(spark, d):
    return filters.exclude(code_graph(spark, d, saved=False), "node_modules|/tools/").edges.select("source", "ord", "resolved")


@q(code("SELECT source, ord, resolved FROM e WHERE regexp_matches(source, '^[0-9]+/libs/') AND regexp_matches(resolved, '^[0-9]+/libs/')"))
def f02_include_only(spark, d):
    return filters.include_only(code_graph(spark, d, saved=False), "^[0-9]+/libs/").edges.select("source", "ord", "resolved")


@q(code("SELECT source, regexp_matches(source, '/kernel/') AS matchesFocus FROM m WHERE source IN (SELECT source FROM m WHERE regexp_matches(source, '/kernel/') UNION SELECT dst FROM p WHERE regexp_matches(src, '/kernel/') UNION SELECT src FROM p WHERE regexp_matches(dst, '/kernel/'))"))
def f03_focus(spark, d):
    return filters.focus(code_graph(spark, d), "/kernel/", 1).modules.select("source", "matchesFocus")


@q(code("SELECT DISTINCT node AS source FROM r", "r AS (SELECT source AS node FROM m WHERE regexp_matches(source, '^[0-9]+/apps/.*/(graph|retry)\\.') UNION SELECT p.src FROM r JOIN p ON p.dst = r.node)", True))
def f04_reaches(spark, d):
    return filters.reaches(code_graph(spark, d), "^[0-9]+/apps/.*/(graph|retry)\\.").modules.select("source")


@q(code("SELECT source, regexp_matches(source, '\\.py$') AS matchesHighlight FROM m"))
def f05_highlight(spark, d):
    return filters.highlight(code_graph(spark, d, saved=False), "\\.py$").modules.select("source", "matchesHighlight")


_DIR = "CASE WHEN position('/' IN {0}) = 0 THEN '.' ELSE regexp_replace({0}, '/[^/]*$', '') END"


@q(code(f"SELECT DISTINCT {_DIR.format('source')} AS source, {_DIR.format('resolved')} AS resolved FROM e"))
def f06_consolidate_folders(spark, d):
    return filters.consolidate(code_graph(spark, d)).edges.select("source", "resolved")


@q(code("SELECT source, resolved, count(*) OVER (PARTITION BY source) AS targets FROM (SELECT DISTINCT regexp_extract(source, '^[0-9]+/[^/]+/[^/]+') AS source, CASE WHEN regexp_extract(resolved, '^[0-9]+/[^/]+/[^/]+') = '' THEN resolved ELSE regexp_extract(resolved, '^[0-9]+/[^/]+/[^/]+') END AS resolved FROM e) WHERE source != resolved"))
def f07_f11_collapse(spark, d):
    e = filters.consolidate(code_graph(spark, d), pattern="^[0-9]+/[^/]+/[^/]+", drop_self=True).edges
    return e.join(e.groupBy("source").agg(F.count(F.lit(1)).alias("targets")), "source").select("source", "resolved", "targets")


_VIEW = {"ignore": [{"from": "/apps/", "to": "/libs/"}, {"to": "fetch|typing"}], "dependencyTypesNot": ["type-only"], "modulesNot": "/tools/", "redirect": [{"to": "node_modules/([^/@]+)", "into": "node_modules"}]}


@q(code("SELECT source, ord, CASE WHEN regexp_matches(resolved, 'node_modules/([^/@]+)') THEN 'node_modules' ELSE resolved END AS resolved FROM e WHERE NOT (regexp_matches(source, '/apps/') AND regexp_matches(resolved, '/libs/')) AND NOT regexp_matches(resolved, 'fetch|typing') AND NOT coalesce(list_has_any(dependencyTypes, ['type-only']), false) AND NOT regexp_matches(source, '/tools/') AND NOT regexp_matches(resolved, '/tools/')"))
def f14_f16_view(spark, d):
    view = ru.rule({"graph": _VIEW}).graph
    return view_edges(code_graph(spark, d, saved=False).edges, view).select("source", "ord", "resolved")


@q(code("SELECT source, ord, resolved FROM e WHERE source NOT IN (SELECT resolved FROM e WHERE dnf OR regexp_matches(resolved, '/packages/'))"))
def f21_do_not_follow(spark, d):
    return filters.do_not_follow(code_graph(spark, d), "/packages/").edges.select("source", "ord", "resolved")


# --- derivations -------------------------------------------------------------

_CLOSE = "c AS (SELECT src AS a, dst AS b FROM p UNION SELECT c.a, p.dst FROM c JOIN p ON p.src = c.b)"
_SCC = f"{_CLOSE}, s AS (SELECT x.a AS node, min(x.b) AS scc FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


@q(code("SELECT node, scc FROM s", _SCC, True))
def g02_components(spark, d):
    return gr.components(code_graph(spark, d).pairs)


@q(code("SELECT e.source, e.ord, e.resolved FROM e JOIN s x ON x.node = e.source JOIN s y ON y.node = e.resolved WHERE x.scc = y.scc", _SCC, True))
def g05_inside_components(spark, d):
    return gr.mark_circular(code_graph(spark, d), exact=False).edges.where("circular").select("source", "ord", "resolved")


@q()
def g04_cycles(spark, d):
    return gr.cycles(code_graph(spark, d))


@q(code("SELECT dst AS source, list_sort(list(src)) AS dependents FROM p GROUP BY dst"))
def g06_dependents(spark, d):
    return gr.dependents(code_graph(spark, d, saved=False))


_SEED = "regexp_matches(source, '^[0-9]+/apps/checkout/')"


@q(code("SELECT seed, node, min(level) AS level FROM r GROUP BY seed, node", f"r AS (SELECT src AS seed, dst AS node, 1 AS level FROM p WHERE {_SEED.replace('source', 'src')} UNION SELECT r.seed, p.dst, level + 1 FROM r JOIN p ON p.src = r.node WHERE level < 3)", True))
def g08_dependencies_to_depth(spark, d):
    g = code_graph(spark, d)
    s = gr.select_nodes(g, "^[0-9]+/apps/checkout/")
    return gr.reach(g.pairs, s.select(F.col("node").alias("seed"), "node"), 3)


@q(code("SELECT seed, node FROM r", f"r AS (SELECT src AS seed, dst AS node FROM p WHERE {_SEED.replace('source', 'src')} UNION SELECT r.seed, p.dst FROM r JOIN p ON p.src = r.node)", True))
def g09_reachable(spark, d):
    g = code_graph(spark, d)
    s = gr.select_nodes(g, "^[0-9]+/apps/checkout/")
    return gr.reach(g.pairs, s.select(F.col("node").alias("seed"), "node")).select("seed", "node")


@q(code("SELECT seed AS \"from\", node AS \"to\", min(level) AS steps FROM r WHERE regexp_matches(node, '/libs/') AND seed != node GROUP BY seed, node", f"r AS (SELECT src AS seed, dst AS node, 1 AS level FROM p WHERE {_SEED.replace('source', 'src')} UNION SELECT r.seed, p.dst, level + 1 FROM r JOIN p ON p.src = r.node WHERE level < 12)", True))
def g10_path_lengths(spark, d):
    g = code_graph(spark, d)
    s = gr.select_nodes(g, "^[0-9]+/apps/checkout/").select(F.col("node").alias("seed"), "node")
    hit = gr.reach(g.pairs, s).where("node rlike '/libs/' and seed != node").select(F.col("seed").alias("from"), F.col("node").alias("to"))
    return gr.paths(g, hit).select("from", "to", F.size("via").alias("steps"))


@q(code("SELECT source FROM m WHERE regexp_matches(source, '^[0-9]+/libs/') AND source NOT IN (SELECT source FROM l) AND source NOT IN (SELECT resolved FROM l)", "l AS (SELECT source, resolved FROM e WHERE regexp_matches(source, '^[0-9]+/libs/') AND regexp_matches(resolved, '^[0-9]+/libs/'))"))
def g11_orphans(spark, d):
    return gr.orphans(filters.include_only(code_graph(spark, d), "^[0-9]+/libs/"))


@q(code("SELECT source, ce, ca, instability FROM i", _METRICS))
def g15_module_metrics(spark, d):
    return me.couplings(code_graph(spark, d))


@q(code("SELECT e.source, e.ord, coalesce(i.instability, 0.0) AS instability FROM e LEFT JOIN i ON i.source = e.resolved", _METRICS))
def g15_edge_metrics(spark, d):
    return me.with_metrics(code_graph(spark, d)).edges.select("source", "ord", "instability")


_CHANGED = "regexp_matches(source, '/(graph|theme)\\.[a-z]+$')"


@q(code("SELECT node AS source, min(level) AS level FROM r GROUP BY node", f"r AS (SELECT source AS node, 0 AS level FROM m WHERE {_CHANGED} UNION SELECT p.src, level + 1 FROM r JOIN p ON p.dst = r.node WHERE level < 4)", True))
def g20_affected(spark, d):
    g = code_graph(spark, d)
    c = gr.select_nodes(g, "/(graph|theme)\\.[a-z]+$").select(F.col("node").alias("path"), F.lit("modified").alias("kind"), F.lit(None).cast("string").alias("old_path"))
    return wi.affected(g, c, 4)


# --- aggregation -------------------------------------------------------------

_FOLDERS = f"""f AS (SELECT source, unnest(list_transform(range(1, len(string_split(dir, '/')) + 1), lambda n: array_to_string(list_slice(string_split(dir, '/'), 1, n), '/'))) AS name FROM (SELECT source, {_DIR.format('source')} AS dir FROM m WHERE calculable)),
 fc AS (SELECT name, count(*) AS moduleCount FROM f GROUP BY name), fo AS (SELECT name, count(*) AS ce FROM f JOIN e USING (source) WHERE NOT starts_with(e.resolved, name || '/') GROUP BY name),
 fi AS (SELECT name, count(*) AS ca FROM f JOIN p ON p.dst = f.source WHERE NOT starts_with(p.src, name || '/') GROUP BY name),
 ft AS (SELECT name, moduleCount, coalesce(ca, 0) AS afferentCouplings, coalesce(ce, 0) AS efferentCouplings, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) = 0 THEN 0.0 ELSE CAST(coalesce(ce, 0) AS DOUBLE) / (coalesce(ca, 0) + coalesce(ce, 0)) END AS instability FROM fc LEFT JOIN fo USING (name) LEFT JOIN fi USING (name)),
 fe AS (SELECT DISTINCT name, CASE WHEN position('/' IN e.resolved) = 0 THEN e.resolved ELSE {_DIR.format('e.resolved')} END AS "to" FROM f JOIN e USING (source) WHERE NOT starts_with(e.resolved, name || '/'))"""


@q(code("SELECT * FROM ft", _FOLDERS))
def a02_folders(spark, d):
    return me.folder_table(code_graph(spark, d)).select("name", "moduleCount", "afferentCouplings", "efferentCouplings", "instability")


@q(code('SELECT fe.name, fe."to", a.instability AS from_instability, coalesce(b.instability, 0.0) AS instability FROM fe LEFT JOIN ft a ON a.name = fe.name LEFT JOIN ft b ON b.name = fe."to"', _FOLDERS))
def a04_folder_edges(spark, d):
    g = code_graph(spark, d)
    return me.folder_edges(g, me.folder_table(g))


@q(code('SELECT DISTINCT "to" AS name, CAST(-1 AS BIGINT) AS moduleCount FROM fe WHERE "to" NOT IN (SELECT name FROM ft)', _FOLDERS))
def a05_sinks(spark, d):
    g = code_graph(spark, d)
    t = me.folder_table(g)
    return me.sinks(t, me.folder_edges(g, t))


_PROJECTS = """po AS (SELECT m.project AS name, coalesce(n.project, e.resolved) AS "to" FROM m JOIN e USING (source) LEFT JOIN m n ON n.source = e.resolved WHERE m.calculable AND m.project IS NOT NULL AND m.project != coalesce(n.project, e.resolved)),
 pi AS (SELECT m.project AS name, coalesce(n.project, p.src) AS f FROM m JOIN p ON p.dst = m.source LEFT JOIN m n ON n.source = p.src WHERE m.calculable AND m.project IS NOT NULL AND m.project != coalesce(n.project, p.src)),
 pt AS (SELECT a.name, moduleCount, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM (SELECT project AS name, count(*) AS moduleCount FROM m WHERE calculable AND project IS NOT NULL GROUP BY project) a LEFT JOIN (SELECT name, count(*) AS ce FROM po GROUP BY name) b USING (name) LEFT JOIN (SELECT name, count(*) AS ca FROM pi GROUP BY name) c USING (name))"""


@q(code("SELECT name, moduleCount, ca AS afferentCouplings, ce AS efferentCouplings, CASE WHEN ca + ce = 0 THEN 0.0 ELSE CAST(ce AS DOUBLE) / (ca + ce) END AS instability FROM pt", _PROJECTS))
def a07_projects(spark, d):
    return me.project_table(code_graph(spark, d))[0].select("name", "moduleCount", "afferentCouplings", "efferentCouplings", "instability")


@q(code("SELECT resolved, count(*) AS fan_in FROM e GROUP BY resolved"))
def a13_fan_in(spark, d):
    return gr.fan_in(code_graph(spark, d, saved=False))


@q(code("SELECT (SELECT count(*) FROM m) AS totalCruised, (SELECT count(*) FROM e) AS totalDependenciesCruised"))
def a15_totals(spark, d):
    return me.totals(code_graph(spark, d, saved=False))


@q(code("SELECT language, count(*) AS modules FROM m GROUP BY language"))
def a16_receipts(spark, d):
    return me.receipts(code_graph(spark, d, saved=False))


@q(code("SELECT DISTINCT unnest(list_transform(range(1, len(string_split(source, '/')) + 1), lambda n: array_to_string(list_slice(string_split(source, '/'), 1, n), '/'))) AS folder FROM m"))
def a01_parent_folders(spark, d):
    return code_graph(spark, d, saved=False).modules.select(F.explode(parents(F.col("source"))).alias("folder")).distinct()


# --- rules -------------------------------------------------------------------

RULES = {
    "forbidden": [
        {"name": "no-app-to-tool", "severity": "error", "comment": "adr:0007", "fix": "move it", "from": {"path": "^[0-9]+/apps/"}, "to": {"path": "^[0-9]+/tools/"}},
        {"name": "no-dev", "severity": "warn", "from": {"pathNot": "/test/"}, "to": {"dependencyTypes": ["npm-dev"]}},
        {"name": "unresolved", "severity": "info", "to": {"couldNotResolve": True}},
        {"name": "own-package", "severity": "error", "from": {"path": "^([0-9]+)/packages/([^/]+)/"}, "to": {"path": "^$1/packages/", "pathNot": "^$1/packages/$2/"}},
    ]
}
_RULED = """v AS (SELECT source, resolved, ord, dependencyKind, 'no-app-to-tool' AS rule, 'error' AS severity FROM e WHERE regexp_matches(source, '^[0-9]+/apps/') AND regexp_matches(resolved, '^[0-9]+/tools/')
 UNION ALL SELECT source, resolved, ord, dependencyKind, 'no-dev', 'warn' FROM e WHERE NOT regexp_matches(source, '/test/') AND list_has_any(dependencyTypes, ['npm-dev'])
 UNION ALL SELECT source, resolved, ord, dependencyKind, 'unresolved', 'info' FROM e WHERE couldNotResolve
 UNION ALL SELECT source, resolved, ord, dependencyKind, 'own-package', 'error' FROM e WHERE regexp_matches(source, '^([0-9]+)/packages/([^/]+)/') AND starts_with(resolved, regexp_extract(source, '^([0-9]+)/packages/', 1) || '/packages/') AND NOT starts_with(resolved, regexp_extract(source, '^([0-9]+/packages/[^/]+/)', 1))),
 k AS (SELECT source, resolved, arg_min(coalesce(dependencyKind, ''), ord) AS kind FROM e GROUP BY source, resolved),
 u AS (SELECT DISTINCT source AS "from", resolved AS "to", rule, severity, 'RB-' || substr(sha256(rule || chr(10) || source || chr(10) || resolved || chr(10) || kind), 1, 8) AS id FROM v JOIN k USING (source, resolved))"""


def ruled(spark: SparkSession, d: str) -> ev.Result:
    return ev.evaluate(code_graph(spark, d), ru.load(RULES))


@q(code("SELECT source, ord, resolved, rule, severity FROM v", _RULED))
def v09_forbidden(spark, d):
    g = code_graph(spark, d, saved=False)
    rs = ru.load(RULES)
    v = ev.verdicts(g.edges.withColumn("from_instability", F.lit(None).cast("double")), [(i, r, edge_predicate(r)) for i, r in enumerate(rs.forbidden)])
    return v.select("source", "ord", "resolved", F.col("rule.name").alias("rule"), F.col("rule.severity").alias("severity"))


@q(code("SELECT * FROM u", _RULED))
def v17_evaluate(spark, d):
    """Flagship: a rule set over the graph to unique findings with stable ids."""
    return ruled(spark, d).violations.select("from", "to", "rule", "severity", "id")


@q(code("SELECT count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'info') AS info, count(*) FILTER (WHERE severity = 'ignore') AS ignore FROM u", _RULED))
def a09_severity_counts(spark, d):
    return ruled(spark, d).counts()


@q(code("SELECT source, resolved FROM e WHERE NOT (regexp_matches(source, '/libs/') AND regexp_matches(resolved, '/libs/')) AND NOT list_has_any(coalesce(dependencyTypes, []), ['local', 'npm'])"))
def v08_allowed(spark, d):
    rs = ru.load({"allowed": [{"from": {"path": "/libs/"}, "to": {"path": "/libs/"}}, {"to": {"dependencyTypes": ["local", "npm"]}}], "allowedSeverity": "info"})
    return ev.dependency_violations(code_graph(spark, d, saved=False), rs).select(F.col("from").alias("source"), F.col("to").alias("resolved"))


@q(code("SELECT source FROM m WHERE regexp_matches(source, '^[0-9]+/apps/') AND NOT regexp_matches(source, '/kernel/|/shared/') AND source NOT IN (SELECT source FROM e WHERE regexp_matches(resolved, '/kernel/|/shared/'))"))
def v07_required(spark, d):
    rs = ru.load({"required": [{"name": "use-kernel", "module": {"path": "^[0-9]+/apps/"}, "to": {"path": "/kernel/|/shared/"}}]})
    return ev.module_violations(code_graph(spark, d), rs).select(F.col("from").alias("source"))


@q(code("SELECT m.source FROM m LEFT JOIN (SELECT dst, count(*) FILTER (WHERE regexp_matches(src, '/src/')) AS n FROM p GROUP BY dst) x ON x.dst = m.source WHERE regexp_matches(m.source, '^[0-9]+/') AND coalesce(n, 0) > 5"))
def v05_dependents_more(spark, d):
    rs = ru.load({"forbidden": [{"name": "popular", "from": {"path": "/src/"}, "module": {"path": "^[0-9]+/", "numberOfDependentsMoreThan": 5}}]})
    return ev.module_violations(code_graph(spark, d), rs).select(F.col("from").alias("source"))


@q(code("SELECT m.source FROM m JOIN (SELECT dst, count(*) AS n FROM p GROUP BY dst) x ON x.dst = m.source WHERE regexp_matches(m.source, '^[0-9]+/libs/') AND n < 2"))
def v05_dependents_less(spark, d):
    rs = ru.load({"forbidden": [{"name": "lonely", "module": {"path": "^[0-9]+/libs/", "numberOfDependentsLessThan": 2}}]})
    return ev.module_violations(code_graph(spark, d), rs).select(F.col("from").alias("source"))


@q(code("SELECT DISTINCT seed AS \"from\", node AS \"to\" FROM r WHERE regexp_matches(node, '^[0-9]+/tools/') AND seed != node", f"r AS (SELECT src AS seed, dst AS node FROM p WHERE {_SEED.replace('source', 'src')} UNION SELECT r.seed, p.dst FROM r JOIN p ON p.src = r.node)", True))
def v04_reaches_rule(spark, d):
    rs = ru.load({"forbidden": [{"name": "no-way", "severity": "error", "from": {"path": "^[0-9]+/apps/checkout/"}, "to": {"path": "^[0-9]+/tools/", "reachable": True}}]})
    return ev.module_violations(code_graph(spark, d, asked=["dependencyTypes"]), rs).select("from", "to")


@q(code("SELECT source FROM m WHERE regexp_matches(source, '^[0-9]+/libs/') AND source NOT IN (SELECT node FROM r WHERE seed != node)", "r AS (SELECT src AS seed, dst AS node FROM p WHERE regexp_matches(src, '^[0-9]+/apps/') UNION SELECT r.seed, p.dst FROM r JOIN p ON p.src = r.node)", True))
def v03_unreachable_rule(spark, d):
    rs = ru.load({"forbidden": [{"name": "dead", "from": {"path": "^[0-9]+/apps/"}, "to": {"path": "^[0-9]+/libs/", "reachable": False}}]})
    return ev.module_violations(code_graph(spark, d), rs).select(F.col("from").alias("source"))


@q(code("SELECT fe.name AS \"from\", fe.\"to\" FROM fe JOIN ft a ON a.name = fe.name LEFT JOIN ft b ON b.name = fe.\"to\" WHERE regexp_matches(fe.name, '^[0-9]+/libs') AND a.instability < coalesce(b.instability, 0.0)", _FOLDERS))
def v11_folder_rule(spark, d):
    rs = ru.load({"forbidden": [{"name": "sdp", "scope": "folder", "from": {"path": "^[0-9]+/libs"}, "to": {"moreUnstable": True}}]})
    return ev.evaluate(code_graph(spark, d), rs).violations.select("from", "to")


@q(code("SELECT DISTINCT name AS \"from\", \"to\" FROM po WHERE regexp_matches(name, '/apps/') AND regexp_matches(\"to\", '/apps/')", _PROJECTS))
def v11_project_rule(spark, d):
    rs = ru.load({"forbidden": [{"name": "apps-apart", "scope": "project", "from": {"path": "/apps/"}, "to": {"path": "/apps/"}}]})
    return ev.evaluate(code_graph(spark, d), rs).violations.select("from", "to")


@q()
def v09_cycle_rule(spark, d):
    rs = ru.load({"forbidden": [{"name": "no-circular", "severity": "error", "from": {}, "to": {"circular": True, "viaOnly": {"pathNot": "node_modules"}}}]})
    g = code_graph(spark, d, asked=["module", "dependencyTypes", "dependencyKind"])
    return ev.cycle_findings(g, rs).select("from", "to", "rule", "steps", "id")


@q(code("SELECT rule, fromMatches, toMatches FROM (SELECT 'no-app-to-tool' AS rule, (SELECT count(*) FROM m WHERE regexp_matches(source, '^[0-9]+/apps/')) AS fromMatches, (SELECT count(*) FROM e WHERE regexp_matches(resolved, '^[0-9]+/tools/')) AS toMatches UNION ALL SELECT 'no-dev', (SELECT count(*) FROM m WHERE NOT regexp_matches(source, '/test/')), 0 UNION ALL SELECT 'unresolved', (SELECT count(*) FROM m), 0 UNION ALL SELECT 'own-package', (SELECT count(*) FROM m WHERE regexp_matches(source, '^([0-9]+)/packages/([^/]+)/')), 0)"))
def a10_rule_counts(spark, d):
    return ev.rule_counts(code_graph(spark, d), ru.load(RULES))


@q(code("SELECT \"from\", \"to\", rule FROM u WHERE NOT regexp_matches(\"from\", '/apps/') AND NOT regexp_matches(\"to\", '/apps/')", _RULED))
def f19_rewrap(spark, d):
    return ev.rewrap(ruled(spark, d), {"exclude": "/apps/"}).violations.select("from", "to", "rule")


@q(code("SELECT DISTINCT rule, a AS \"from\", b AS \"to\" FROM (SELECT v.rule, v.source, v.resolved, CASE WHEN regexp_extract(v.source, '^[0-9]+/[^/]+/[^/]+') = '' THEN v.source ELSE regexp_extract(v.source, '^[0-9]+/[^/]+/[^/]+') END AS a, CASE WHEN regexp_extract(v.resolved, '^[0-9]+/[^/]+/[^/]+') = '' THEN v.resolved ELSE regexp_extract(v.resolved, '^[0-9]+/[^/]+/[^/]+') END AS b FROM v) x JOIN (SELECT CASE WHEN regexp_extract(source, '^[0-9]+/[^/]+/[^/]+') = '' THEN source ELSE regexp_extract(source, '^[0-9]+/[^/]+/[^/]+') END AS a, CASE WHEN regexp_extract(resolved, '^[0-9]+/[^/]+/[^/]+') = '' THEN resolved ELSE regexp_extract(resolved, '^[0-9]+/[^/]+/[^/]+') END AS b, arg_min({'s': source, 't': resolved}, {'s': source, 'o': ord}) AS f FROM e GROUP BY 1, 2) y USING (a, b) WHERE a != b AND y.f.s = x.source AND y.f.t = x.resolved", _RULED))
def f19_rewrap_collapsed(spark, d):
    return ev.rewrap(ruled(spark, d), {"collapse": "^[0-9]+/[^/]+/[^/]+"}).violations.select("from", "to", "rule")


# --- known findings and ratchets ---------------------------------------------


def _known(v: DataFrame) -> DataFrame:
    """A third of the findings as a baseline, a third of it expired."""
    h = F.conv(F.substring("id", 4, 2), 16, 10).cast("int")
    return v.where(h % 3 == 0).withColumn("expires", F.when(h % 9 == 0, F.lit(date(2026, 1, 1)))).withColumn("owner", F.lit("team"))


_KNOWN = "h AS (SELECT *, (position(substr(id, 4, 1) IN '0123456789abcdef') - 1) * 16 + position(substr(id, 5, 1) IN '0123456789abcdef') - 1 AS h FROM u)"


@q(code('SELECT "from", "to", rule, CASE WHEN h % 3 = 0 AND h % 9 != 0 THEN \'ignore\' ELSE severity END AS severity FROM h', f"{_RULED}, {_KNOWN}"))
def b04_soften(spark, d):
    from depweave.session import materialize

    v = materialize(ruled(spark, d).violations, "violations")
    return kn.soften(v, _known(v), TODAY).select("from", "to", "rule", "severity")


@q(code('SELECT "from", "to", rule FROM h WHERE h % 3 = 0 AND severity = \'error\'', f"{_RULED}, {_KNOWN}"))
def b07_stale(spark, d):
    from depweave.session import materialize

    v = materialize(ruled(spark, d).violations, "violations")
    return kn.stale(v.where("severity != 'error'"), _known(v), TODAY).select("from", "to", "rule")


@q(code('SELECT id, rule, CASE WHEN h % 9 = 0 THEN \'2026-01-01\' END AS expires, CASE WHEN h % 3 = 0 THEN \'team\' END AS owner FROM h', f"{_RULED}, {_KNOWN}"))
def b09_baseline(spark, d):
    from depweave.session import materialize

    v = materialize(ruled(spark, d).violations, "violations")
    return kn.baseline(v, _known(v), TODAY).select("id", "rule", F.col("expires").cast("string").alias("expires"), "owner")


@q(code("SELECT rule, state, count(*) AS n FROM (SELECT rule, CASE WHEN severity = 'info' THEN 'old' WHEN h % 2 = 0 THEN 'same' ELSE 'new' END AS state FROM h WHERE severity = 'info' OR rule != 'x') GROUP BY ALL", f"{_RULED}, {_KNOWN}"))
def b10_diff_findings(spark, d):
    from depweave.session import materialize

    v = materialize(ruled(spark, d).violations, "violations")
    h = F.conv(F.substring("id", 4, 2), 16, 10).cast("int")
    old = v.where((F.col("severity") == "info") | (h % 2 == 0)).withColumn("severity", F.lit("ignore"))
    new = v.where("severity != 'info'")
    return kn.diff_violations(old, new).groupBy("rule", "state").agg(F.count(F.lit(1)).alias("n"))


@q(code("SELECT 'apps-to-libs' AS name, count(*) AS count, CAST(100 AS BIGINT) AS ceiling, CASE WHEN count(*) > 100 THEN 'over' ELSE 'within' END AS verdict, abs(count(*) - 100) AS by FROM e WHERE regexp_matches(source, '/apps/') AND regexp_matches(resolved, '/libs/') UNION ALL SELECT 'inherits', count(*), CAST(NULL AS BIGINT), 'unbudgeted', CAST(NULL AS BIGINT) FROM e WHERE dependencyKind = 'inherits'"))
def b13_ratchets(spark, d):
    rs = ru.load({"ratchets": [{"name": "apps-to-libs", "from": {"path": "/apps/"}, "to": {"path": "/libs/"}, "max": 100}, {"name": "inherits", "to": {"dependencyKind": "inherits"}}]})
    return kn.ratchet_counts(code_graph(spark, d, saved=False), rs.ratchets)


# --- questions ---------------------------------------------------------------


@q(code("SELECT source AS \"from\", resolved AS \"to\" FROM e WHERE regexp_matches(source, '/services/') AND regexp_matches(resolved, '\\.py$')"))
def q01_query(spark, d):
    return wi.query(code_graph(spark, d, saved=False), "/services/", "\\.py$")


_CAND = "cd AS (SELECT DISTINCT resolved AS f, source AS t FROM e WHERE regexp_matches(source, '^[0-9]+/apps/checkout/') AND regexp_matches(resolved, '^[0-9]+/'))"


@q(code("SELECT f AS \"from\", t AS \"to\", EXISTS (SELECT 1 FROM r WHERE r.seed = cd.t AND r.node = cd.f) OR f = t AS circular, NOT (regexp_matches(f, '^[0-9]+/tools/') AND regexp_matches(t, '^[0-9]+/apps/')) AS allowed FROM cd", f"{_CAND}, r AS (SELECT src AS seed, dst AS node FROM p WHERE {_SEED.replace('source', 'src')} UNION SELECT r.seed, p.dst FROM r JOIN p ON p.src = r.node)", True))
def q03_can_import(spark, d):
    g = code_graph(spark, d)
    c = g.edges.where("source rlike '^[0-9]+/apps/checkout/' and resolved rlike '^[0-9]+/'").select(F.col("resolved").alias("from"), F.col("source").alias("to")).distinct()
    rs = ru.load({"forbidden": [{"name": "tools-apart", "severity": "error", "from": {"path": "^[0-9]+/tools/"}, "to": {"path": "^[0-9]+/apps/"}}]})
    return wi.can_import(g, rs, c).select("from", "to", "circular", "allowed")


@q(code("SELECT seed AS file, node AS dependent, min(level) AS level FROM r WHERE seed != node GROUP BY ALL", "r AS (SELECT dst AS seed, src AS node, 1 AS level FROM p WHERE regexp_matches(dst, '/kernel/') UNION SELECT r.seed, p.src, level + 1 FROM r JOIN p ON p.dst = r.node WHERE level < 2)", True))
def q05_impact(spark, d):
    g = code_graph(spark, d)
    return wi.impact(g, gr.select_nodes(g, "/kernel/").select(F.col("node").alias("file")), 2)


@q(code("SELECT source AS file, rule, side FROM (SELECT source, 'no-app-to-tool' AS rule, CASE WHEN regexp_matches(source, '^[0-9]+/apps/') THEN 'from' WHEN regexp_matches(source, '^[0-9]+/tools/') THEN 'to' END AS side FROM m UNION ALL SELECT source, 'no-dev', CASE WHEN NOT regexp_matches(source, '/test/') THEN 'from' END FROM m UNION ALL SELECT source, 'unresolved', 'from' FROM m) WHERE side IS NOT NULL"))
def q06_rules_mentioning(spark, d):
    rs = ru.load({"forbidden": RULES["forbidden"][:3]})
    return wi.rules_mentioning(rs, code_graph(spark, d).modules.select(F.col("source").alias("file")))


@q(code("SELECT DISTINCT name AS folder FROM f", _FOLDERS))
def q08_place_candidates(spark, d):
    return wi.place_candidates(code_graph(spark, d))


@q(code("SELECT DISTINCT name AS folder, NOT regexp_matches(name || '/new.ts', '^[0-9]+/apps/') AS legal FROM f", _FOLDERS))
def q07_place(spark, d):
    g = code_graph(spark, d)
    rs = ru.load({"forbidden": RULES["forbidden"][:1]})
    return wi.place(g, rs, "new.ts", ["0/tools/x/y.ts"]).select("folder", "legal")


@q(code("SELECT source AS \"from\", resolved AS \"to\", 'removed' AS change FROM (SELECT DISTINCT source, resolved FROM e WHERE regexp_matches(source, '/apps/')) WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.source = source AND false) UNION ALL SELECT DISTINCT source, resolved, 'added' FROM e WHERE regexp_matches(source, '/libs/')"))
def q11_diff(spark, d):
    g = code_graph(spark, d)
    old, new = g.with_(edges=g.edges.where("not source rlike '/libs/'")), g.with_(edges=g.edges.where("not source rlike '/apps/'"))
    return wi.diff_edges(old, new).select("from", "to", "change")


@q(code("SELECT DISTINCT source AS \"from\", resolved AS \"to\", a AS from_side, b AS to_side FROM (SELECT source, resolved, CASE WHEN regexp_matches(source, '/apps/') THEN '1' WHEN regexp_matches(source, '/services/') THEN '2' WHEN regexp_matches(source, '/libs/') THEN '3' END AS a, CASE WHEN regexp_matches(resolved, '/apps/') THEN '1' WHEN regexp_matches(resolved, '/services/') THEN '2' WHEN regexp_matches(resolved, '/libs/') THEN '3' END AS b FROM e) WHERE a != b"))
def q14_changelog(spark, d):
    e = code_graph(spark, d, saved=False).edges.select(F.col("source").alias("from"), F.col("resolved").alias("to")).distinct()
    return wi.changelog(e, {"layers": ["/apps/", "/services/", "/libs/"]}).select("from", "to", "from_side", "to_side")


@q()
def q13_snapshot(spark, d):
    return wi.snapshot(ruled(spark, d), "1.0.0")


@q()
def q09_fix_plans(spark, d):
    g = code_graph(spark, d)
    rs = ru.load({"forbidden": RULES["forbidden"][:1]})
    return wi.fix_plans(g, rs, ev.evaluate(g, rs).violations)


@q(code("SELECT a.project AS a, b.project AS b, CASE WHEN split_part(a.project, '/', 1) != split_part(b.project, '/', 1) THEN 6 WHEN split_part(a.project, '/', 2) != split_part(b.project, '/', 2) THEN 4 WHEN a.project != b.project THEN 2 ELSE 0 END AS distance FROM (SELECT DISTINCT a.project, b.project AS p2 FROM e JOIN m a ON a.source = e.source JOIN m b ON b.source = e.resolved WHERE a.project IS NOT NULL AND b.project IS NOT NULL) a JOIN (SELECT DISTINCT project FROM m) b ON b.project = a.p2"))
def q10_folder_distance(spark, d):
    g = code_graph(spark, d)
    e = ev.with_facts(g).where("from_project is not null and to_project is not null").select(F.col("from_project").alias("a"), F.col("to_project").alias("b")).distinct()
    return e.select("a", "b", wi.folder_distance(F.col("a"), F.col("b")).alias("distance"))


@q("WITH e AS (SELECT CASE WHEN coreModule OR couldNotResolve THEN resolved ELSE repo || '/' || resolved END AS r, repo || '/' || source AS s FROM edges) SELECT DISTINCT s AS source, r AS resolved FROM e")
def s19_fleet(spark, d):
    """The union of all repositories."""
    return wi.fleet_table(table(spark, d, "edges")).edges.select("source", "resolved").distinct()


# --- scans -------------------------------------------------------------------


@q(DOCUMENT_EDGES_SQL)
def s01_documents(spark, d):
    """Every readable document, as edges."""
    return shred.document_edges(table(spark, d, "raw_graphs"), "body")


@q(code("SELECT source, language FROM m"))
def s03_language(spark, d):
    return code_graph(spark, d, saved=False).modules.select("source", "language")


@q(code("SELECT DISTINCT e.source, e.module, e.resolved IN (SELECT source FROM m WHERE calculable) AS known FROM e"))
def s07_known_targets(spark, d):
    g = code_graph(spark, d)
    known = g.modules.where(me.calculable()).select(F.col("source").alias("resolved"), F.lit(True).alias("k"))
    return g.edges.join(known, "resolved", "left").select("source", "module", F.coalesce("k", F.lit(False)).alias("known")).distinct()


@q(code("SELECT source AS path, CASE WHEN dnf THEN 'renamed' WHEN core THEN 'deleted' ELSE 'modified' END AS kind FROM m WHERE NOT regexp_matches(source, '\\s')"))
def s22_diff_lines(spark, d):
    m = code_graph(spark, d).modules
    line = F.when(F.col("matchesDoNotFollow"), F.concat(F.lit("R100\told/"), "source", F.lit("\t"), "source")).when(F.col("coreModule"), F.concat(F.lit("D\t"), "source")).otherwise(F.concat(F.lit("M\t"), "source"))
    return so.diff_lines(m.select(line.alias("line")), "line").select("path", "kind")


@q("WITH " + FK_SQL + " SELECT DISTINCT f.source AS \"from\", g.resolved AS \"to\" FROM fk f JOIN fk g ON g.source = f.resolved WHERE starts_with(f.source, 'customer/')")
def s17_declared(spark, d):
    """Declared edges from customers to regions whose ends exist."""
    g = fk_graph(spark, d)
    e = g.edges
    two = e.where("source like 'customer/%'").select(F.col("source").alias("from"), "resolved").join(e.select(F.col("source").alias("resolved"), F.col("resolved").alias("to")), "resolved").select("from", "to", F.col("to").alias("module"), F.lit("data").alias("kind"), F.lit(None).cast("string").alias("comment"))
    ghost = so.read_declared(spark, '{"declared": [{"from": "no", "to": "where"}]}')
    done, _ = so.apply_declared(g, two.unionByName(ghost))
    return done.edges.where("dependencyKind = 'declared'").select(F.col("source").alias("from"), F.col("resolved").alias("to")).distinct()


@q("WITH RECURSIVE " + FK_SQL + ", r AS (SELECT source AS node, 0 AS level FROM fk WHERE source = 'nation/3' UNION SELECT fk.source, level + 1 FROM r JOIN fk ON fk.resolved = r.node) SELECT node AS source, min(level) AS level FROM r GROUP BY node")
def g07_fk_dependents(spark, d):
    g = fk_graph(spark, d)
    return gr.reach_set(g.pairs, spark.createDataFrame([("nation/3",)], "node string"), reverse=True).select(F.col("node").alias("source"), "level")


@q("WITH " + FK_SQL + " SELECT DISTINCT regexp_extract(source, '^[^/]+') AS source, regexp_extract(resolved, '^[^/]+') AS resolved FROM fk")
def f07_fk_schema(spark, d):
    return filters.consolidate(fk_graph(spark, d), pattern="^[^/]+").edges.select("source", "resolved")


# --- slices and diagrams -----------------------------------------------------

_SLICED = "sx AS (SELECT DISTINCT regexp_extract(e.source, '^[0-9]+/libs/([^/]+)', 1) AS f, regexp_extract(e.resolved, '^[0-9]+/libs/([^/]+)', 1) AS t, e.source || ' -> ' || e.resolved AS mm FROM e WHERE NOT coreModule AND NOT couldNotResolve AND regexp_matches(e.source, '/libs/') AND regexp_matches(e.resolved, '/libs/'))"


def _slices(spark: SparkSession, d: str) -> DataFrame:
    return sl.slice_edges(code_graph(spark, d), sl.parse("/libs/(*)", segments=1))


@q(code("SELECT f AS \"from\", t AS \"to\", count(*) AS edges FROM sx WHERE f != t GROUP BY ALL", _SLICED))
def l05_slice_edges(spark, d):
    return _slices(spark, d).select("from", "to", F.size("members").cast("bigint").alias("edges"))


@q(code("SELECT f AS slice, list_sort(list(DISTINCT t)) AS targets, count(*) AS edges FROM sx WHERE f != t GROUP BY f", _SLICED))
def l06_slices_apart(spark, d):
    return sl.not_depend_on_each_other(_slices(spark, d))


@q(code("SELECT min(b) AS component, list_sort(list(DISTINCT b)) AS slices FROM (SELECT x.a, x.b FROM c x JOIN c y ON x.a = y.b AND x.b = y.a) GROUP BY a", f"{_SLICED}, sp AS (SELECT DISTINCT f AS src, t AS dst FROM sx WHERE f != t), c AS (SELECT src AS a, dst AS b FROM sp UNION SELECT c.a, sp.dst FROM c JOIN sp ON sp.src = c.b)", True).replace("SELECT min(b) AS component", "SELECT DISTINCT min(b) AS component"))
def l07_slice_cycles(spark, d):
    return sl.free_of_cycles(_slices(spark, d)).select("component", "slices")


@q("WITH " + LAYER_SQL + " SELECT key AS type, NOT EXISTS (SELECT 1 FROM td JOIN t b ON b.key = td.target WHERE td.source = t.key AND starts_with(t.ns, 'Shop.Brand1') AND starts_with(b.ns, 'Shop.Brand2')) AS passed FROM t WHERE starts_with(ns, 'Shop.Brand1') OR starts_with(ns, 'Shop.Brand2')")
def x04_diagram(spark, d):
    c = code_layer(spark, d)
    diagram = diagrams.parse("[One] <<Shop\\.Brand1.*>>\n[Two] <<Shop\\.Brand2.*>>\n[Two] --> [One]\n")
    return diagrams.adherence(c.types.select(F.col("fullName").alias("type"), F.get("namespaces", F.lit(0)).alias("namespace")), c.dependencies.select("source", "target"), diagram)


# --- elements ----------------------------------------------------------------


def _element(name: str, rule: dict, sql: str) -> None:
    @q("WITH " + LAYER_SQL + " " + sql, name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return elements.evaluate(code_layer(spark, d), rule)[0]


_element("e07_visibility", {"select": {"kind": "type", "where": {"resideInNamespaceMatching": "^Shop\\.Brand1"}}, "should": {"bePublic": True}}, "SELECT key, visibility = 'public' AS passed FROM t WHERE regexp_matches(ns, '^Shop\\.Brand1')")
_element("c11_names", {"select": {"kind": "class"}, "should": {"any": [{"haveNameStartingWith": ["Part1", "Part2"]}, {"haveFullNameEndingWith": "0"}]}}, "SELECT key, starts_with(name, 'Part1') OR starts_with(name, 'Part2') OR suffix(lower(key), '0') AS passed FROM t WHERE kind = 'class'")
_element("c28_depend_on", {"select": {"kind": "type"}, "should": {"dependOnAny": {"kind": "interface"}}}, "SELECT key, EXISTS (SELECT 1 FROM td JOIN t x ON x.key = td.target WHERE td.source = t.key AND x.kind = 'interface') AS passed FROM t")
_element("c29_only_depend_on", {"select": {"kind": "type"}, "should": {"onlyDependOn": {"kind": "type", "where": {"arePublic": True}}}}, "SELECT key, NOT EXISTS (SELECT 1 FROM td JOIN t x ON x.key = td.target WHERE td.source = t.key AND x.visibility != 'public') AS passed FROM t")
_element("c33_attribute_arguments", {"select": {"kind": "type"}, "should": {"not": {"haveAttributeWithArguments": {"attribute": "Tag", "arguments": ["1"]}}}}, "SELECT key, NOT (k % 5 = 1 AND k % 4 = 1) AS passed FROM t")
_element("c33_attribute_arguments_not", {"select": {"kind": "type"}, "should": {"doNotHaveAttributeWithArguments": {"attribute": "Tag", "arguments": ["1", "2"]}}}, "SELECT key, NOT (k % 5 = 1 AND k % 4 IN (1, 2)) AS passed FROM t")
_element("c52_immutable", {"select": {"kind": "type"}, "should": {"beImmutable": True}}, "SELECT key, k % 2 = 0 AND k % 3 != 0 AS passed FROM t")
_element("c56_read_only", {"select": {"kind": "field"}, "should": {"beReadOnly": True}}, "SELECT key || '::Size' AS key, k % 2 = 0 AS passed FROM t")
_element("c61_called_by", {"select": {"kind": "property"}, "should": {"beCalledBy": {"kind": "class"}}}, "SELECT key || '::Price' AS key, EXISTS (SELECT 1 FROM td JOIN t x ON x.key = td.source WHERE td.target = t.key AND x.kind = 'class') AS passed FROM t")
_element("c37_assignable", {"select": {"kind": "type", "where": {"not": {"assignableTo": {"kind": "type", "where": {"haveNameMatching": "0$"}}}}}, "should": {"haveName": ["part1", "PART2"]}}, "SELECT key, lower(name) IN ('part1', 'part2') AS passed FROM t WHERE NOT suffix(name, '0')")


@q(code("SELECT source AS key, NOT EXISTS (SELECT 1 FROM e WHERE e.source = m.source AND regexp_matches(e.resolved, '/tools/') AND e.resolved IN (SELECT source FROM m WHERE NOT core AND NOT unresolved)) AS passed FROM m WHERE NOT core AND NOT unresolved AND regexp_matches(source, '/apps/')"))
def e02_modules(spark, d):
    c = code_layer(spark, d)
    c = elements.Code.of(c.types, graph=code_graph(spark, d))
    rule = {"select": {"kind": "module", "where": {"haveFullNameMatching": "/apps/"}}, "should": {"notDependOnAny": {"kind": "module", "where": {"haveFullNameMatching": "/tools/"}}}}
    return elements.evaluate(c, rule)[0]


_element("c77_diagram", {"select": {"kind": "type", "where": {"resideInNamespaceMatching": "Brand[12]"}}, "should": {"adhereToPlantUmlDiagram": "[One] <<Shop\\.Brand1.*>>\n[Two] <<Shop\\.Brand2.*>>\n[Two] --> [One]"}}, "SELECT key, NOT EXISTS (SELECT 1 FROM td JOIN t b ON b.key = td.target WHERE td.source = t.key AND starts_with(t.ns, 'Shop.Brand1') AND starts_with(b.ns, 'Shop.Brand2')) AS passed FROM t WHERE starts_with(ns, 'Shop.Brand1') OR starts_with(ns, 'Shop.Brand2')")

# --- sinks -------------------------------------------------------------------


@q(code("SELECT source, resolved, arg_min(CASE WHEN rule IS NULL THEN 'true' ELSE severity END, ord) AS cell FROM (SELECT e.source, e.resolved, e.ord, x.rule, x.severity FROM e LEFT JOIN (SELECT \"from\", \"to\", arg_min(rule, CASE severity WHEN 'error' THEN '0' WHEN 'warn' THEN '1' ELSE '2' END || rule) AS rule, arg_min(severity, CASE severity WHEN 'error' THEN '0' WHEN 'warn' THEN '1' ELSE '2' END || rule) AS severity FROM u GROUP BY ALL) x ON x.\"from\" = e.source AND x.\"to\" = e.resolved) GROUP BY ALL", _RULED))
def k02_incidence(spark, d):
    r = ruled(spark, d)
    return rp.incidence(ev.with_verdicts(r.graph, r.violations))


@q(code("SELECT source || ' → ' || resolved AS line FROM e"))
def k03_text(spark, d):
    return rp.text(code_graph(spark, d))


@q(code("SELECT 'folder' AS type, name, moduleCount, afferentCouplings, efferentCouplings, instability FROM ft UNION ALL SELECT 'project', name, moduleCount, ca, ce, CASE WHEN ca + ce = 0 THEN 0.0 ELSE CAST(ce AS DOUBLE) / (ca + ce) END FROM pt UNION ALL SELECT 'module', source, 1, ca, ce, instability FROM i", f"{_FOLDERS}, {_PROJECTS}, {_METRICS}"))
def k04_metrics(spark, d):
    return rp.metrics_table(code_graph(spark, d))


@q(code("SELECT rule, findings, rank, score, \"from\", \"to\" FROM (SELECT rule, \"from\", \"to\", 1 + coalesce(n, 0) AS score, count(*) OVER (PARTITION BY rule) AS findings, row_number() OVER (PARTITION BY rule ORDER BY 1 + coalesce(n, 0), \"from\", \"to\") AS rank FROM u LEFT JOIN (SELECT resolved, count(*) AS n FROM e GROUP BY resolved) x ON x.resolved = \"to\") WHERE rank <= 5", _RULED))
def k06_agent(spark, d):
    r = ruled(spark, d)
    return rp.agent(r.violations, r.graph).select("rule", "findings", "rank", "score", "from", "to")


@q(code("SELECT x.rule, x.severity, count(u.id) AS findings, count(u.id) = 0 AS passed FROM (SELECT unnest(['no-app-to-tool', 'no-dev', 'unresolved', 'own-package']) AS rule, unnest(['error', 'warn', 'info', 'error']) AS severity) x LEFT JOIN u ON u.rule = x.rule GROUP BY ALL", _RULED))
def k23_catalog(spark, d):
    r = ruled(spark, d)
    return rp.catalog([(x.name, x.severity) for x in r.rules.all()], r.violations)


@q()
def k01_document(spark, d):
    return rp.document(code_graph(spark, d))


_SHAPED = "regexp_replace(regexp_replace(regexp_replace({0}, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g')"


@q(code(f"SELECT a AS shape, n AS edges, count(*) AS modules FROM (SELECT {_SHAPED.format('source')} AS a, source, count(*) AS n FROM e GROUP BY ALL) GROUP BY ALL"))
def k21_anonymous(spark, d):
    """Shapes of the anonymous names with their numbers of edges: no two modules fall together, classes of letters stay."""
    e = rp.anonymize(code_graph(spark, d), key="k", keep=()).edges
    plain = F.regexp_replace("source", "~[0-9]+", "")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9")
    return e.groupBy("source").agg(F.first(shape).alias("shape"), F.count(F.lit(1)).alias("edges")).groupBy("shape", "edges").agg(F.count(F.lit(1)).alias("modules"))


# --- time --------------------------------------------------------------------


@q('SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, extracted_at)) AS BIGINT) AS start, repo, count(*) AS edges FROM edges GROUP BY ALL')
def t07_edge_windows(spark, d):
    return st.edge_windows(table(spark, d, "edges"), "extracted_at", "repo").select(F.unix_seconds("start").alias("start"), "repo", "edges")


@q("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events), g AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT epoch_us(min(ts)) AS start, user_id, count(*) AS edges FROM g GROUP BY user_id, g")
def t07_sessions(spark, d):
    return st.sessions(table(spark, d, "events"), "ts", "user_id", "30 minutes").select(F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "user_id", "edges")


@q("WITH a AS (SELECT repo || '/' || source AS path, max(snapshot_id) AS b FROM graph_snapshots GROUP BY ALL) SELECT path, CASE WHEN b % 3 = 0 THEN 'added' WHEN b % 3 = 1 THEN 'modified' END AS change FROM a WHERE b % 3 != 2")
def t01_changed_inputs(spark, d):
    a = table(spark, d, "graph_snapshots").groupBy(F.concat_ws("/", "repo", "source").alias("path")).agg(F.max("snapshot_id").alias("b"))
    now = a.select("path", F.col("b").cast("string").alias("fingerprint"))
    old = a.where("b % 3 != 0").select("path", F.when(F.col("b") % 3 == 1, "old").otherwise(F.col("b").cast("string")).alias("fingerprint"))
    return st.changed_inputs(now, old)


@q(code("SELECT DISTINCT source, regexp_replace(source, '/[^/]*$', '') AS folder FROM e"))
def f10_dirname(spark, d):
    return code_edges(spark, d).select("source", dirname(normalize_dots(F.concat(F.lit("./"), "source"))).alias("folder")).distinct()
