"""Evaluation of a rule set over a graph: verdicts, violations, order, ids, counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions import regex
from depweave.functions.order import collated, severity_rank
from depweave.operators import metrics
from depweave.operators.circuits import counted_cycles
from depweave.operators.filters import unmatched_ignores
from depweave.operators.graph import STEP, Graph, components, cycles, extremes, mark_circular, orphans, paths, reach
from depweave.plans.compile import cross, edge_predicate, folder_predicate, needs, path_pair, verdicts, via_asks, via_counted, view_edges
from depweave.plans.rules import Rule, RuleSet
from depweave.session import materialize

VIOLATION = {
    "type": "string", "from": "string", "to": "string", "unresolvedTo": "string", "dependencyTypes": "array<string>", "rule": "string", "severity": "string",
    "cycle": f"array<{STEP}>", "via": f"array<{STEP}>", "from_instability": "double", "to_instability": "double",
}


def violation_id(rule: Column, source: Column, target: Column, kind: Column) -> Column:
    """Stable id of a finding."""
    whole = F.concat_ws("\n", rule, source, target, F.coalesce(kind, F.lit("")))
    return F.concat(F.lit("RB-"), F.substring(F.sha2(whole, 256), 1, 8))


def with_facts(g: Graph) -> DataFrame:
    """Edges with what rules ask about both ends."""
    facts = ["language", "project", "namespaces", "assemblies"]
    a = g.modules.select("source", F.col("instability").alias("from_instability"), *[F.col(c).alias("from_" + c) for c in facts])
    b = g.modules.select(F.col("source").alias("resolved"), *[F.col(c).alias("to_" + c) for c in facts])
    return g.edges.join(a, "source", "left").join(b, "resolved", "left")


def violations_table(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns of a violation; those not given are null."""
    return df.select(*[columns.get(c.replace("from", "from_") if c == "from" else c, F.lit(None)).cast(t).alias(c) for c, t in VIOLATION.items()])


def dependency_violations(g: Graph, rules: RuleSet) -> DataFrame:
    """Edges that break rules (V8, V9, Y1). ``g`` carries what ``needs`` says."""
    asked = needs(rules)
    df = with_facts(g) if asked & {"facts", "metrics"} else g.edges.withColumn("from_instability", F.lit(None).cast("double"))
    own = [(i, r, edge_predicate(r)) for i, r in enumerate(rules.forbidden) if r.family == "dependency"]
    allowed = [edge_predicate(r) for r in rules.allowed if r.family == "dependency"]
    v = verdicts(df, own, allowed, rules.allowed_severity)
    circular = [r.name for r in rules.all() if r.to.circular]
    unstable = [r.name for r in rules.all() if r.to.moreUnstable is not None]
    name = F.col("rule.name")
    is_cycle = F.col("cycle").isNotNull() & name.isin(circular)
    is_unstable = F.col("from_instability").isNotNull() & F.col("instability").isNotNull() & name.isin(unstable)
    return violations_table(
        v, type=F.when(is_unstable, "instability").when(is_cycle, "cycle").otherwise("dependency"), from_=F.col("source"), to=F.col("resolved"), unresolvedTo=F.col("module"),
        dependencyTypes=F.col("dependencyTypes"), rule=name, severity=F.col("rule.severity"), cycle=F.when(is_cycle, F.col("cycle")),
        from_instability=F.when(is_unstable, F.col("from_instability")), to_instability=F.when(is_unstable, F.col("instability")),
    )


def _module_rows(m: DataFrame, r: Rule) -> DataFrame:
    return violations_table(m, type=F.lit("module"), from_=F.col("source"), to=F.col("source"), rule=F.lit(r.name), severity=F.lit(r.severity))


def orphan_modules(g: Graph, r: Rule) -> DataFrame:
    """Modules an orphan rule matches."""
    lone = orphans(g)
    m = g.modules.join(lone, "source", "left_semi" if r.from_.orphan else "left_anti")
    for c in ("language", "project", "namespaces", "assemblies"):
        m = m.withColumn("from_" + c, F.col(c))
    return m.where(path_pair(F.col("source"), r.from_.path, r.from_.pathNot) & cross(r.from_.cross, "from_"))


def dependents_modules(g: Graph, r: Rule) -> DataFrame:
    """Modules whose number of dependents breaks a limit (V5, A11, trap 4): a limit of 0 is none; a least number needs dependents."""
    mod = r.module
    # counted, never gathered: the importers of a hot module are combined in the map tasks
    by = g.pairs.groupBy(F.col("dst").alias("source")).agg(F.count_if(path_pair(F.col("src"), r.from_.path, r.from_.pathNot)).alias("n_"))
    m = g.modules.where(path_pair(F.col("source"), mod.path, mod.pathNot)).join(by, "source", "left")
    n = F.coalesce("n_", F.lit(0))
    cond = F.lit(True) if mod.numberOfDependentsMoreThan is not None else F.col("n_").isNotNull()
    if mod.numberOfDependentsLessThan:
        cond = cond & (n < mod.numberOfDependentsLessThan)
    if mod.numberOfDependentsMoreThan:
        cond = cond & (n > mod.numberOfDependentsMoreThan)
    return m.where(cond).drop("n_")


def _seeds(g: Graph, r: Rule) -> DataFrame:
    side = r.module if r.module is not None else r.from_
    return g.modules.where(path_pair(F.col("source"), side.path, side.pathNot)).select(F.col("source").alias("seed"))


def _seen(g: Graph, r: Rule) -> tuple[DataFrame, DataFrame | None]:
    """(src, dst) of the graph the rule sees, and the nodes its chains do not go through."""
    edges = view_edges(g.edges, r.graph)
    pairs = edges.select(F.col("source").alias("src"), F.col("resolved").alias("dst")).distinct()
    if r.graph and r.graph.chainsThrough:
        return pairs, g.modules.where(~regex.matches(F.col("source"), r.graph.chainsThrough)).select(F.col("source").alias("node"))
    return pairs, None


def reached(g: Graph, r: Rule) -> DataFrame:
    """(seed, source): modules that the rule's selecting modules reach in the graph the rule sees, seeds apart from themselves."""
    pairs, blocked = _seen(g, r)
    return reach(pairs, _seeds(g, r).select("seed", F.col("seed").alias("node")), blocked=blocked).select("seed", F.col("node").alias("source")).where("seed != source")


def _reached_by_another(pairs: DataFrame, seeds: DataFrame, blocked: DataFrame | None) -> DataFrame:
    """(source): what some seed (seed) other than itself reaches; one row per node is kept, not one per seed and node."""
    return extremes(pairs, seeds, blocked).where("node != low or node != high").select(F.col("node").alias("source"))


def reaches_violations(g: Graph, r: Rule) -> DataFrame:
    """``reachable: true``: each selecting module and each target it reaches, with a path."""
    seen = g.with_(edges=view_edges(g.edges, r.graph))
    blocked = _seen(g, r)[1]
    if r.from_.path and any(f"${d}" in (p or "") for p in (r.to.path, r.to.pathNot) for d in range(10)):
        hit = reached(g, r).where(path_pair(F.col("source"), r.to.path, r.to.pathNot, regex.captured(F.col("seed"), r.from_.path)))
        ways = paths(seen, materialize(hit.select(F.col("seed").alias("from"), F.col("source").alias("to")), "reached"), blocked)
    else:  # what is looked for is the same for every start
        ends = _seeds(g, r).select(F.col("seed").alias("from"), F.lit(None).cast("string").alias("to"))
        ways = paths(seen, ends, blocked, lambda c: path_pair(c, r.to.path, r.to.pathNot))
    return violations_table(ways, type=F.lit("reachability"), from_=F.col("from"), to=F.col("to"), rule=F.lit(r.name), severity=F.lit(r.severity), via=F.col("via"))


def unreachable_modules(g: Graph, r: Rule) -> DataFrame:
    """``reachable: false``: modules matching ``to`` that no selecting module reaches."""
    m = g.modules.where(path_pair(F.col("source"), r.to.path, r.to.pathNot))
    seeds = _seeds(g, r)
    # a selecting module is not tested against itself
    pairs, blocked = _seen(g, r)
    others = _reached_by_another(pairs, seeds, blocked)
    lone = m.join(others, "source", "left_anti")
    only_self = seeds.select(F.col("seed").alias("source"))
    one = seeds.limit(2).count() <= 1
    return lone.join(only_self, "source", "left_anti") if one else lone


def required_modules(g: Graph, r: Rule) -> DataFrame:
    """Selected modules that neither match nor depend on (nor, with ``reachable``, reach) what is required (V7)."""
    m = g.modules.where(path_pair(F.col("source"), r.module.path, r.module.pathNot))
    found = regex.captured(F.col("source"), r.module.path) if r.module.path else None
    # the required target is to.path alone; pathNot plays no part here
    bad = m.where(~path_pair(F.col("source"), r.to.path, r.to.pathNot, found))
    direct = g.edges.where(path_pair(F.col("resolved"), r.to.path, None, found)).select("source").distinct()
    bad = bad.join(direct, "source", "left_anti")
    if r.to.reachable:
        # walked backwards from what is required
        pairs, blocked = _seen(g, r)
        back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        goals = pairs.where(path_pair(F.col("dst"), r.to.path, r.to.pathNot)).select(F.col("dst").alias("seed")).distinct()
        bad = bad.join(_reached_by_another(back, goals, blocked), "source", "left_anti")
    return bad


def module_violations(g: Graph, rules: RuleSet) -> DataFrame:
    """Findings of rules about modules (V2-V7)."""
    out = [violations_table(g.modules.limit(0))]
    for r in rules.forbidden:
        if r.family != "module":
            continue
        if r.from_.orphan is not None:
            out.append(_module_rows(orphan_modules(g, r), r))
        if r.to.reachable is True:
            out.append(reaches_violations(g, r))
        elif r.to.reachable is False:
            out.append(_module_rows(unreachable_modules(g, r), r))
        if r.module is not None and (r.module.numberOfDependentsLessThan is not None or r.module.numberOfDependentsMoreThan is not None):
            out.append(_module_rows(dependents_modules(g, r), r))
    out += [_module_rows(required_modules(g, r), r) for r in rules.required if r.module is not None]
    allowed = [r for r in rules.allowed if r.family == "module"]
    if allowed:
        fine = None
        for r in allowed:
            m = orphan_modules(g, r).select("source") if r.from_.orphan is not None else dependents_modules(g, r).select("source") if r.module is not None else _allowed_reached(g, r)
            fine = m if fine is None else fine.unionByName(m)
        out.append(_module_rows(g.modules.join(fine.distinct(), "source", "left_anti"), Rule(name="not-in-allowed", severity=rules.allowed_severity)))
    return _union(out)


def _allowed_reached(g: Graph, r: Rule) -> DataFrame:
    pairs, blocked = _seen(g, r)
    return _reached_by_another(pairs, _seeds(g, r), blocked).where(path_pair(F.col("source"), r.to.path, r.to.pathNot))


def aggregate_violations(edges: DataFrame, rules: RuleSet, scope: str) -> DataFrame:
    """Findings of folder or project rules over (name, to, from_instability, instability[, circular, cycle])."""
    mine = [(i, r, folder_predicate(r)) for i, r in enumerate(rules.forbidden) if r.family == scope]
    allowed = [folder_predicate(r) for r in rules.allowed if r.family == scope]
    for c, t in (("circular", "boolean"), ("cycle", f"array<{STEP}>")):
        if c not in edges.columns:
            edges = edges.withColumn(c, F.lit(None).cast(t))
    v = verdicts(edges, mine, allowed, rules.allowed_severity)
    name = F.col("rule.name")
    unstable = name.isin([r.name for r in rules.all() if r.to.moreUnstable is not None])
    cyc = F.col("cycle").isNotNull() & name.isin([r.name for r in rules.all() if r.to.circular])
    return violations_table(
        v, type=F.when(unstable, "instability").when(cyc, "cycle").otherwise(scope), from_=F.col("name"), to=F.col("to"), rule=name, severity=F.col("rule.severity"), cycle=F.when(cyc, F.col("cycle")),
        from_instability=F.when(unstable, F.col("from_instability")), to_instability=F.when(unstable, F.col("instability")),
    )


def aggregate_cycles(edges: DataFrame) -> DataFrame:
    """Folder or project edges with ``circular`` and ``cycle``."""
    order = (F.row_number().over(Window.partitionBy("name").orderBy("to")) - 1).cast("bigint")
    e = edges.withColumn("ord", order)
    g = Graph.of(e.select(F.col("name").alias("source"), F.col("to").alias("resolved"), "ord"))
    found = cycles(g, components(g.pairs)).withColumnRenamed("source", "name")
    return e.join(found, ["name", "ord"], "left").withColumn("circular", F.coalesce(F.size("cycle") > 0, F.lit(False))).drop("ord")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def names_of(c: Column) -> Column:
    return F.transform(c, lambda s: s["name"])


def identity_key(df: DataFrame) -> Column:
    """What makes two findings the same (Y4): rule and, for cycles, the names on it; else the ends and, if given, the names of the path."""
    cyc, way = names_of(F.col("cycle")), names_of(F.col("via"))
    ends = F.struct(F.col("from").alias("a"), F.col("to").alias("b"), F.array_sort(F.coalesce(way, F.array().cast("array<string>"))).alias("c"))
    loop = F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.array_sort(F.coalesce(cyc, F.array().cast("array<string>"))).alias("c"))
    return F.struct(F.col("rule"), F.when(F.size(F.coalesce(cyc, F.array().cast("array<string>"))) > 0, loop).otherwise(ends).alias("k"))


def order_columns() -> list[Column]:
    """Severity, rule, ends, then the rest, under the root collation with binary tie-break."""
    text = lambda c: [collated(F.coalesce(c, F.lit(""))), c]
    listed = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "\n")
    return [
        severity_rank(F.col("severity")), *text(F.col("rule")), *text(F.col("from")), *text(F.col("to")), *text(F.col("unresolvedTo")), *text(F.col("type")),
        *text(listed(F.col("dependencyTypes"))), *text(listed(names_of(F.col("cycle")))), *text(listed(names_of(F.col("via")))),
    ]


def unique(v: DataFrame) -> DataFrame:
    """Of findings that are the same the first in order is kept (Y5). A key's findings are reduced map-side."""
    keyed = v.withColumn("key_", identity_key(v))
    return keyed.groupBy("key_").agg(F.min_by(F.struct(*v.columns), _rank(F.col("cycle"))).alias("v_")).select("v_.*")


def _rank(cycle: Column) -> Column:
    return F.struct(severity_rank(F.col("severity")).alias("r"), F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("from", "to", "unresolvedTo", "type")]).alias("t"), F.to_json(F.struct("dependencyTypes", cycle.alias("cycle"), "via")).alias("x"))


def annotate(v: DataFrame, g: Graph, rules: RuleSet) -> DataFrame:
    """Stable id, fix and decision token of every finding."""
    # findings are few beside edges: only edges of their ends are grouped
    v = materialize(v, "findings")
    ends = v.select("from", "to").distinct()
    mine = g.edges.select(F.col("source").alias("from"), F.col("resolved").alias("to"), "ord", "dependencyKind").join(ends, ["from", "to"], "left_semi")
    kind = mine.groupBy("from", "to").agg(F.min_by("dependencyKind", "ord").alias("kind_"))
    edge = F.col("type").isin("dependency", "cycle", "instability")
    out = v.join(kind, ["from", "to"], "left")
    out = out.withColumn("id", violation_id(F.col("rule"), F.col("from"), F.col("to"), F.when(edge, F.col("kind_")))).drop("kind_")
    return _said(out, rules)


def _said(v: DataFrame, rules: RuleSet) -> DataFrame:
    """What the rules say about their findings."""
    meta = {r.name: r for r in reversed(rules.all())}
    pick = lambda f: _choice({n: f(r) for n, r in meta.items() if f(r)})
    return v.withColumn("fix", pick(lambda r: r.fix)).withColumn("decision", pick(lambda r: r.decision)).withColumn("comment", pick(lambda r: r.comment))


def _choice(values: dict[str, str]) -> Column:
    if not values:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("rule"))


def severity_counts(v: DataFrame) -> DataFrame:
    """One row: error, warn, info, ignore."""
    return v.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warn", "info", "ignore")])


def rule_counts(g: Graph, rules: RuleSet) -> DataFrame:
    """(rule, fromMatches, toMatches): modules selected, and targets matched where ``to.path`` is there without a placeholder (A10, trap 19).

    One aggregation over modules and one over edges for all rules.
    """
    rs = [(i, r) for i, r in enumerate(rules.all())]
    if not rs:
        return g.modules.sparkSession.createDataFrame([], "rule string, fromMatches bigint, toMatches bigint")
    frm = g.modules.agg(*[F.count_if(path_pair(F.col("source"), *r.selecting)).alias(f"r{i}") for i, r in rs]).first()
    plain = {i: r for i, r in rs if r.to.path and not any(f"${d}" in r.to.path for d in range(10))}
    by_module = {i for i, r in plain.items() if r.module_only}
    over = lambda ids, df, c: dict(df.agg(*[F.count_if(path_pair(F.col(c), plain[i].to.path, plain[i].to.pathNot)).alias(f"r{i}") for i in ids]).first().asDict()) if ids else {}
    to = over(by_module, g.modules, "source") | over(set(plain) - by_module, g.edges, "resolved")
    return g.modules.sparkSession.createDataFrame([(r.name, frm[f"r{i}"], to.get(f"r{i}", 0)) for i, r in rs], "rule string, fromMatches bigint, toMatches bigint")


def vacuous(g: Graph, rules: RuleSet) -> list[str]:
    """Rules whose selecting side matches no module, or with ignores that match no edge."""
    counts = {row["rule"]: row["fromMatches"] for row in rule_counts(g, rules).collect()}
    out = []
    for r in [*rules.forbidden, *rules.required]:
        if not r.allowEmpty and (not counts.get(r.name) or r.graph and unmatched_ignores(g, r.graph)):
            out.append(r.name)
    return out


def expired(rules: RuleSet, today: date) -> list[str]:
    """Rules past their last day (V15); the run date is given, never read from a clock."""
    return [r.name for r in rules.all() if r.expires is not None and today > r.expires]


@dataclass
class Result:
    """What an evaluation gives; everything is lazy."""

    graph: Graph
    rules: RuleSet
    violations: DataFrame
    folders: DataFrame | None = None
    folder_edges: DataFrame | None = None
    projects: DataFrame | None = None
    project_edges: DataFrame | None = None

    def ordered(self) -> DataFrame:
        return self.violations.orderBy(*order_columns())

    def counts(self) -> DataFrame:
        return severity_counts(self.violations)

    def exit_code(self, today: date | None = None, over_budget: int = 0, stale: int = 0) -> int:
        """Errors, capped at 255 (Y13, Y14); expired rules, exceeded ratchets and stale entries count where they are given."""
        errors = self.counts().first()["error"]
        return min(255, errors + (len(expired(self.rules, today)) if today else 0) + over_budget + stale)


def derive(g: Graph, rules: RuleSet, exact: bool = True) -> Graph:
    """Only the derivations that some rule asks for."""
    asked = needs(rules)
    if "cycles" in asked:
        g = mark_circular(g, exact)
        g = g.with_(edges=materialize(g.edges, "circular"))
    if "metrics" in asked:
        g = metrics.with_metrics(g)
    return g


def evaluate(g: Graph, rules: RuleSet, exact: bool = True) -> Result:
    """A rule set over a graph (V17): derive, judge, reduce, annotate. Equal input gives equal output whatever the partitioning."""
    asked = needs(rules)
    g = derive(g, rules, exact)
    out = [dependency_violations(g, rules), module_violations(g, rules)]
    extra = {}
    for scope in ("folder", "project"):
        if scope + "s" in asked:
            if scope == "folder":
                table = metrics.folder_table(g)
                edges = metrics.folder_edges(g, table)
            else:
                table, edges = metrics.project_table(g)
            if any(r.to.circular is not None and r.scope == scope for r in rules.all()):
                edges = aggregate_cycles(edges)
            extra |= {scope + "s": table, scope + "_edges": edges}
            out.append(aggregate_violations(edges, rules, scope))
    return Result(g, rules, annotate(unique(_union(out)), g, rules), **extra)


def cycle_findings(g: Graph, rules: RuleSet) -> DataFrame:
    """The findings of ``evaluate`` with the number of ``steps`` of their cycles in place of the steps.

    Where all rules are against edges on cycles and ask nothing about their
    ends' captured groups, no cycle is written out: the search counts its steps
    and those that fulfil what ``via`` and ``viaOnly`` ask, the set of its names
    is told by 128 bits, and only edges on cycles are judged.
    """
    mine = rules.forbidden
    vias = [(i, r, k) for i, r in enumerate(mine) for k in ("via", "viaOnly") if getattr(r.to, k) is not None]
    captured = any(r.from_.path and f"${d}" in (p or "") for _, r, k in vias for p in (getattr(r.to, k).path, getattr(r.to, k).pathNot) for d in range(10))
    if captured or needs(rules) != {"cycles"} or len(mine) != len(rules.all()) or not all(r.family == "dependency" and r.to.circular for r in mine):
        return evaluate(g, rules).violations.withColumn("steps", F.size("cycle")).drop("cycle")
    asks = [(i, k, f(F.col("step"))) for i, r, k in vias for f, _ in via_asks(getattr(r.to, k), None)]
    found = counted_cycles(g, components(g.pairs), [a for *_, a in asks])
    df = found.withColumn("circular", F.lit(True))

    def judged(i: int, r: Rule) -> Column:
        out = edge_predicate(replace(r, to=replace(r.to, via=None, viaOnly=None)))
        for k in ("via", "viaOnly"):
            asked = via_counted(getattr(r.to, k), [F.col("hits")[x] for x, (j, name, _) in enumerate(asks) if (j, name) == (i, k)], F.col("steps"), k == "viaOnly")
            out = out if asked is None else out & asked
        return out

    v = verdicts(df, [(i, r, judged(i, r)) for i, r in enumerate(mine)])
    v = v.select(
        F.lit("cycle").alias("type"), F.col("source").alias("from"), F.col("resolved").alias("to"), F.col("module").alias("unresolvedTo"), "dependencyTypes", F.col("rule.name").alias("rule"), F.col("rule.severity").alias("severity"),
        F.lit(None).cast(f"array<{STEP}>").alias("via"), F.lit(None).cast("double").alias("from_instability"), F.lit(None).cast("double").alias("to_instability"), "steps", "kind_", F.col("key").alias("key_"),
    )
    # as in ``unique``: edges between the same two have the same cycle, so its place in the order is all that is left of it
    v = v.groupBy("rule", "key_").agg(F.min_by(F.struct(*[c for c in v.columns if c != "key_"]), _rank(F.array().cast(f"array<{STEP}>"))).alias("v_")).select("v_.*")
    return _said(v.withColumn("id", violation_id(F.col("rule"), F.col("from"), F.col("to"), F.col("kind_"))).drop("kind_"), rules)


def with_verdicts(g: Graph, violations: DataFrame) -> Graph:
    """Edges and modules with ``valid`` and ``rules`` sorted by severity and name."""
    entry = F.struct(severity_rank(F.col("severity")).alias("rank"), F.col("rule").alias("name"), F.col("severity"))
    edge = violations.where(F.col("type").isin("dependency", "cycle", "instability")).groupBy(F.col("from").alias("source"), F.col("to").alias("resolved")).agg(F.array_sort(F.collect_set(entry)).alias("r_"))
    mod = violations.where(F.col("type").isin("module", "reachability")).groupBy(F.col("from").alias("source")).agg(F.array_sort(F.collect_set(entry)).alias("r_"))
    told = lambda df: df.withColumn("valid", F.col("r_").isNull()).withColumn("rules", F.transform("r_", lambda x: F.struct(x["name"].alias("name"), x["severity"].alias("severity")))).drop("r_")
    return Graph(told(g.modules.drop("rules").join(mod, "source", "left")), told(g.edges.drop("rules").join(edge, ["source", "resolved"], "left")))


def rewrap(r: Result, options: dict) -> Result:
    """A saved evaluation filtered, collapsed and summarised anew (F19): nothing is judged again.

    After a collapse only findings of the first edge between two names stay,
    since that edge stands for all of them; element and slice findings are kept.
    """
    from depweave.operators.filters import apply_filters, collapse_pattern, consolidate, regexp_first

    g = apply_filters(r.graph, options)
    own = r.violations.where(F.col("type").isin("element", "slice"))
    edge = r.violations.where(F.col("type").isin("dependency", "cycle", "instability"))
    mod = r.violations.where(F.col("type").isin("module", "reachability"))
    ends = g.edges.select(F.col("source").alias("from"), F.col("resolved").alias("to"), "ord")
    here = g.modules.select(F.col("source").alias("from"))
    mod = mod.join(here, "from", "left_semi")
    if options.get("collapse") is None:
        edge = edge.join(ends.select("from", "to").distinct(), ["from", "to"], "left_semi")
        return Result(g, r.rules, own.unionByName(edge.select(own.columns)).unionByName(mod.select(own.columns)), r.folders, r.folder_edges, r.projects, r.project_edges)
    p = collapse_pattern(options["collapse"])
    short = lambda c: F.when(regexp_first(F.col(c), p) != "", regexp_first(F.col(c), p)).otherwise(F.col(c))
    order = F.struct(F.coalesce("m_", F.lit(0)), "from", "ord")
    first = ends.join(g.modules.select(F.col("source").alias("from"), F.col("ord").alias("m_")), "from", "left").groupBy(short("from").alias("a_"), short("to").alias("b_")).agg(F.min_by(F.struct("from", "to"), order).alias("f_"))
    edge = edge.join(first.where("a_ != b_").select("f_.from", "f_.to"), ["from", "to"], "left_semi")
    out = edge.select(own.columns).unionByName(mod.select(own.columns)).withColumn("from", short("from")).withColumn("to", short("to"))
    out = out.dropDuplicates(["rule", "from", "to", "type"])
    return Result(consolidate(g, pattern=p, drop_self=True), r.rules, own.unionByName(out), r.folders, r.folder_edges, r.projects, r.project_edges)
