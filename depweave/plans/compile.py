"""Rules compiled to Catalyst predicates (P1-P37, F14-F16, V1-V9). No Python runs per row.

An edge predicate reads the columns of an edge (``source``, ``resolved``,
``dependencyTypes``, flags ...) and, where a rule asks for them, facts of both
ends under ``from_`` and ``to_``. Absent is not false: a flag that is null
equals neither true nor false.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.functions import regex
from depweave.functions.paths import dirname, normalize_dots
from depweave.plans.rules import DUPLICATES_THAT_MATTER, Cross, GraphView, Rule, RuleSet, To, Via

#: Rules evaluated in one projection; more are split so that generated code stays within the JVM's method limit.
RULES_PER_PASS = 25


def equals(c: Column, want: bool | None) -> Column | None:
    """The property must be there and have the value."""
    return None if want is None else F.coalesce(c == F.lit(want), F.lit(False))


def _text(c: Column, p: str | None) -> Column | None:
    """There, not empty, and matching."""
    return None if p is None else (F.coalesce(c, F.lit("")) != "") & regex.matches(c, p)


def _text_not(c: Column, p: str | None) -> Column | None:
    """P5: there, not empty, and not matching."""
    return None if p is None else (F.coalesce(c, F.lit("")) != "") & ~regex.matches(c, p)


def all_of(preds: Sequence[Column | None]) -> Column:
    out = F.lit(True)
    for p in preds:
        if p is not None:
            out = out & p
    return out


def path_pair(c: Column, path: str | None, path_not: str | None, found: Column | None = None) -> Column:
    """``path`` matches and ``pathNot`` does not, ``$n`` standing for captured groups."""
    return all_of([
        None if path is None else regex.matches_with(c, path, found),
        None if path_not is None else ~regex.matches_with(c, path_not, found),
    ])


def _overlap(types: Column, wanted: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(types, F.array(*[F.lit(t) for t in wanted])), F.lit(False))


def via_asks(v: Via, found: Column | None) -> list[tuple[Callable[[Column], Column], bool]]:
    """What is asked of the steps of a cycle, and whether it must not hold; ``pathNot`` takes the place of ``path``'s answer."""
    out: list[tuple[Callable[[Column], Column], bool]] = []
    if v.pathNot is not None:
        out.append((lambda s: regex.matches_with(s["name"], v.pathNot, found), True))
    elif v.path is not None:
        out.append((lambda s: regex.matches_with(s["name"], v.path, found), False))
    if v.dependencyTypes is not None:
        out.append((lambda s: _overlap(s["dependencyTypes"], v.dependencyTypes), False))
    if v.dependencyTypesNot is not None:
        out.append((lambda s: _overlap(s["dependencyTypes"], v.dependencyTypesNot), True))
    return out


def via(v: Via | None, cycle: Column, found: Column | None, only: bool) -> Column | None:
    """Over the steps of the edge's cycle. No cycle passes."""
    if v is None:
        return None
    out = F.lit(True)
    for f, no in via_asks(v, found):
        hit = F.forall(cycle, f) if only != no else F.exists(cycle, f)
        out = out & (~hit if no else hit)
    return F.when(cycle.isNull(), True).otherwise(out)


def via_counted(v: Via | None, hits: list[Column], steps: Column, only: bool) -> Column | None:
    """``via`` where it is known how many of the steps of a cycle fulfil each of ``via_asks``."""
    if v is None:
        return None
    out = F.lit(True)
    for n, (_, no) in zip(hits, via_asks(v, None), strict=True):
        hit = n == steps if only != no else n > 0
        out = out & (~hit if no else hit)
    return out


def more_unstable(want: bool | None, a: Column, b: Column) -> Column | None:
    """P20."""
    return None if want is None else F.coalesce(a < b if want else a >= b, F.lit(False))


def ancestor(want: bool | None, source: Column, target: Column, core: Column, unresolved: Column) -> Column | None:
    """The target's folder is a proper prefix of the source's, both resolved below a deep virtual root."""
    if want is None:
        return None
    root = "/" + "/".join("abcdefghijklmnopqrst")
    folder = lambda c: F.concat(F.regexp_replace(dirname(normalize_dots(F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(root + "/"), c)))), "/+$", ""), F.lit("/"))
    a, b = folder(source), folder(target)
    above = a.startswith(b) & (F.length(a) > F.length(b))
    no = F.coalesce(core, F.lit(False)) | F.coalesce(unresolved, F.lit(False))
    return ~no & F.coalesce(above == F.lit(want), F.lit(False))


def cross(k: Cross, side: str) -> Column:
    """P26, P27 for one side; a property that is not recorded matches neither form."""
    col = lambda n: F.col(side + n)
    ns, asm = col("namespaces"), col("assemblies")
    some = lambda a, p: F.coalesce(F.exists(a, lambda x: regex.matches(x, p)), F.lit(False))
    none = lambda a, p: F.coalesce((F.size(a) > 0) & ~F.exists(a, lambda x: regex.matches(x, p)), F.lit(False))
    return all_of([
        None if k.language is None else F.coalesce(col("language").isin(list(k.language)), F.lit(False)),
        None if k.namespace is None else some(ns, k.namespace),
        None if k.namespaceNot is None else none(ns, k.namespaceNot),
        None if k.project is None else _text(col("project"), k.project),
        None if k.projectNot is None else _text_not(col("project"), k.projectNot),
        None if k.assembly is None else some(asm, k.assembly),
        None if k.assemblyNot is None else none(asm, k.assemblyNot),
    ])


def kinds(to: To) -> Column | None:
    """P28."""
    out = []
    if to.dependencyKind is not None:
        out.append(F.coalesce(F.col("dependencyKind").isin(list(to.dependencyKind)), F.lit(False)))
    if to.dependencyKindNot is not None:
        out.append(F.coalesce(~F.col("dependencyKind").isin(list(to.dependencyKindNot)), F.lit(False)))
    return all_of(out) if out else None


def redirected(view: GraphView | None, resolved: Column) -> Column:
    """where an import leads in the rule's graph; the first entry that matches decides."""
    out = resolved
    for to, into in reversed(view.redirect if view else ()):
        out = F.when(regex.matches(resolved, to), F.lit(into)).otherwise(out)
    return out


def removed(view: GraphView, source: Column, resolved: Column, types: Column) -> Column:
    """Edges the rule's graph lacks."""
    led = redirected(view, resolved)
    out = [(led != resolved) & (led == source)]
    if view.modulesNot:
        out.append(regex.matches(source, view.modulesNot) | regex.matches(led, view.modulesNot))
    if view.dependencyTypesNot:
        out.append(_overlap(types, view.dependencyTypesNot))
    for frm, to in view.ignore:
        out.append(all_of([None if frm is None else regex.matches(source, frm), None if to is None else regex.matches(led, to)]))
    return regex.any_of(out)


def view_edges(edges: DataFrame, view: GraphView | None) -> DataFrame:
    """The edges of the graph a rule sees, ``resolved`` redirected."""
    if view is None:
        return edges
    kept = edges.where(~removed(view, F.col("source"), F.col("resolved"), F.col("dependencyTypes")))
    return kept.withColumn("resolved", redirected(view, F.col("resolved"))) if view.redirect else kept


def edge_predicate(rule: Rule) -> Column:
    """The conjunction of everything a dependency rule says about an edge."""
    to, source = rule.to, F.col("source")
    target = redirected(rule.graph, F.col("resolved"))
    found = regex.captured(source, rule.from_.path) if rule.from_.path else None
    types = F.col("dependencyTypes")
    return all_of([
        path_pair(source, rule.from_.path, rule.from_.pathNot),
        path_pair(target, to.path, to.pathNot, found),
        None if to.dependencyTypes is None else _overlap(types, to.dependencyTypes),
        None if to.dependencyTypesNot is None else ~_overlap(types, to.dependencyTypesNot),
        None if to.moreThanOneDependencyType is None else (F.coalesce(F.size(F.filter(types, lambda t: F.coalesce(t.isin(DUPLICATES_THAT_MATTER), F.lit(False)))), F.lit(0)) > 1) == F.lit(to.moreThanOneDependencyType),
        equals(F.col("preCompilationOnly"), to.preCompilationOnly),
        equals(F.col("couldNotResolve"), to.couldNotResolve),
        equals(F.col("circular"), to.circular),
        equals(F.col("dynamic"), to.dynamic),
        equals(F.col("exoticallyRequired"), to.exoticallyRequired),
        _text(F.col("license"), to.license), _text_not(F.col("license"), to.licenseNot),
        _text(F.col("exoticRequire"), to.exoticRequire), _text_not(F.col("exoticRequire"), to.exoticRequireNot),
        via(to.via, F.col("cycle"), found, only=False),
        via(to.viaOnly, F.col("cycle"), found, only=True),
        more_unstable(to.moreUnstable, F.col("from_instability"), F.col("instability")),
        ancestor(to.ancestor, source, target, F.col("coreModule"), F.col("couldNotResolve")),
        cross(rule.from_.cross, "from_") if rule.from_.cross.given() else None,
        cross(to.cross, "to_") if to.cross.given() else None,
        kinds(to),
        ~removed(rule.graph, source, F.col("resolved"), types) if rule.graph else None,
    ])


def folder_predicate(rule: Rule) -> Column:
    """A folder or project edge (``name``, ``to``, instabilities, ``circular``)."""
    name = F.col("name")
    found = regex.captured(name, rule.from_.path) if rule.from_.path else None
    return all_of([
        path_pair(name, rule.from_.path, rule.from_.pathNot),
        path_pair(F.col("to"), rule.to.path, rule.to.pathNot, found),
        more_unstable(rule.to.moreUnstable, F.col("from_instability"), F.col("instability")),
        equals(F.col("circular"), rule.to.circular),
    ])


def needs(rules: RuleSet) -> set[str]:
    """Derivations that some rule asks for (V21, V22): cycles, metrics, facts, dependents, orphans, reach, folders, projects."""
    out: set[str] = set()
    for r in rules.all():
        if r.to.circular is not None or r.to.via is not None or r.to.viaOnly is not None:
            out.add("cycles")
        if r.to.moreUnstable is not None:
            out.add("metrics")
        if r.scope in ("folder", "project"):
            out |= {r.scope + "s", "metrics"}
        if r.from_.cross.given() or r.to.cross.given():
            out.add("facts")
        if r.from_.orphan is not None:
            out.add("orphans")
        if r.to.reachable is not None:
            out.add("reach")
        if r.module is not None:
            out.add("dependents")
    return out


def struct_of(rule: Rule, order: int) -> Column:
    return F.struct(F.lit(order).alias("order"), F.lit(rule.name).alias("name"), F.lit(rule.severity).alias("severity"))


def verdicts(df: DataFrame, rules: Sequence[tuple[int, Rule, Column]], allowed: Sequence[Column] = (), allowed_severity: str | None = None) -> DataFrame:
    """One row per (row of ``df``, rule it breaks): the columns of ``df`` and ``rule`` (V8, V9).

    All rules of a pass are evaluated in one scan; an edge that no ``allowed``
    predicate admits gets a single ``not-in-allowed``.
    """
    passes: list[list[Column]] = []
    if allowed:
        passes.append([F.when(~regex.any_of(list(allowed)), F.struct(F.lit(-1).alias("order"), F.lit("not-in-allowed").alias("name"), F.lit(allowed_severity).alias("severity")))])
    for i in range(0, len(rules), RULES_PER_PASS):
        passes.append([F.when(p, struct_of(r, o)) for o, r, p in rules[i : i + RULES_PER_PASS]])
    out = None
    for p in passes:
        part = df.withColumn("rule", F.explode(F.array_compact(F.array(*p))))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = df.withColumn("rule", F.lit(None).cast("struct<order:int,name:string,severity:string>")).limit(0)
    return out
