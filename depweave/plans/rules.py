"""The rule language: dataclasses, loader, normalisation, shorthands (V18-V20, V23, V24, P19, U3, U4). Plan time only."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, replace
from datetime import date

from depweave.functions import regex

# Fixed values of the document vocabulary.
DEPENDENCY_TYPES = """
aliased-subpath-import aliased-tsconfig-base-url aliased-tsconfig-paths aliased-tsconfig aliased-webpack aliased-workspace aliased
amd-define amd-require amd-exotic-require core deprecated dynamic-import exotic-require export import-equals import
jsdoc jsdoc-bracket-import jsdoc-import-tag local localmodule npm-bundled npm-dev npm-no-pkg npm-optional npm-peer npm-unknown npm
pre-compilation-only process-get-builtin-module require triple-slash-amd-dependency triple-slash-directive
triple-slash-file-reference triple-slash-type-reference type-import type-only undetermined unknown
project package framework test-only signature-only unresolved stdlib site dynamic
""".split()
DEPENDENCY_KINDS = "import inherits implements field signature body attribute generic-argument typeof call declared".split()
LANGUAGES = "typescript javascript dotnet python".split()
# Types of which a second one on the same edge counts as a duplicate.
DUPLICATES_THAT_MATTER = "core local localmodule npm npm-bundled npm-dev npm-no-pkg npm-optional npm-peer npm-unknown".split()
# Which cross-language key each language records.
RECORDED = {
    "namespace": ("dotnet", "python"),
    "project": ("dotnet", "python"),
    "assembly": ("dotnet",),
    "dependencyKind": ("dotnet", "typescript", "javascript", "python"),
}


class RuleError(ValueError):
    """A rule file that is not valid."""


@dataclass(frozen=True)
class Cross:
    """Keys that hold for all languages: of one side of an edge."""

    language: tuple[str, ...] | None = None
    namespace: str | None = None
    namespaceNot: str | None = None
    project: str | None = None
    projectNot: str | None = None
    assembly: str | None = None
    assemblyNot: str | None = None

    def given(self) -> list[str]:
        return [f.name for f in fields(self) if getattr(self, f.name) is not None]


@dataclass(frozen=True)
class Via:
    path: str | None = None
    pathNot: str | None = None
    dependencyTypes: tuple[str, ...] | None = None
    dependencyTypesNot: tuple[str, ...] | None = None


@dataclass(frozen=True)
class From:
    path: str | None = None
    pathNot: str | None = None
    orphan: bool | None = None
    cross: Cross = Cross()


@dataclass(frozen=True)
class To:
    path: str | None = None
    pathNot: str | None = None
    couldNotResolve: bool | None = None
    circular: bool | None = None
    dynamic: bool | None = None
    exoticallyRequired: bool | None = None
    exoticRequire: str | None = None
    exoticRequireNot: str | None = None
    preCompilationOnly: bool | None = None
    dependencyTypes: tuple[str, ...] | None = None
    dependencyTypesNot: tuple[str, ...] | None = None
    moreThanOneDependencyType: bool | None = None
    license: str | None = None
    licenseNot: str | None = None
    via: Via | None = None
    viaOnly: Via | None = None
    moreUnstable: bool | None = None
    ancestor: bool | None = None
    reachable: bool | None = None
    dependencyKind: tuple[str, ...] | None = None
    dependencyKindNot: tuple[str, ...] | None = None
    cross: Cross = Cross()


@dataclass(frozen=True)
class Module:
    path: str | None = None
    pathNot: str | None = None
    numberOfDependentsLessThan: int | None = None
    numberOfDependentsMoreThan: int | None = None


@dataclass(frozen=True)
class GraphView:
    """What a rule takes out of the graph before it looks."""

    ignore: tuple[tuple[str | None, str | None], ...] = ()
    dependencyTypesNot: tuple[str, ...] | None = None
    modulesNot: str | None = None
    chainsThrough: str | None = None
    redirect: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Rule:
    name: str = "unnamed"
    severity: str = "warn"
    comment: str | None = None
    fix: str | None = None
    owner: str | None = None
    expires: date | None = None
    since: str | None = None
    deprecated: str | None = None
    replacedBy: str | None = None
    allowEmpty: bool = False
    examples: dict = field(default_factory=dict, compare=False, hash=False)
    scope: str = "module"
    from_: From = From()
    to: To = To()
    module: Module | None = None
    graph: GraphView | None = None

    @property
    def module_only(self) -> bool:
        """Orphan, reachability and dependents rules look at modules, others at edges (V1)."""
        return self.from_.orphan is not None or self.to.reachable is not None or self.module is not None

    @property
    def family(self) -> str:
        """dependency, module, folder or project: the matcher that finds the rule interesting."""
        if self.scope in ("folder", "project"):
            return "none" if self.module_only else self.scope
        return "module" if self.module_only else "dependency"

    @property
    def decision(self) -> str | None:
        return decision_token(self.comment or "")

    @property
    def selecting(self) -> tuple[str | None, str | None]:
        """(path, pathNot) of the side that selects modules."""
        side = self.module if self.module is not None else self.from_
        return side.path, side.pathNot


@dataclass(frozen=True)
class Ratchet:
    name: str
    from_: From = From()
    to: To = To()
    max: int | None = None


@dataclass(frozen=True)
class RuleSet:
    forbidden: tuple[Rule, ...] = ()
    allowed: tuple[Rule, ...] = ()
    allowed_severity: str | None = None
    required: tuple[Rule, ...] = ()
    ratchets: tuple[Ratchet, ...] = ()

    def all(self) -> list[Rule]:
        return [*self.allowed, *self.forbidden, *self.required]

    def named(self, name: str) -> Rule | None:
        return next((r for r in self.all() if r.name == name), None)


def decision_token(comment: str) -> str | None:
    """``adr:NNNN`` or ``plan:slug`` in a rule's comment."""
    m = re.search(r"(?<![A-Za-z0-9])adr:([0-9]+)", comment)
    if m:
        return f"adr:{m.group(1)}"
    m = re.search(r"(?<![A-Za-z0-9])plan:([A-Za-z0-9_-]+)", comment)
    return f"plan:{m.group(1)}" if m else None


def _list(v: object, vocabulary: Sequence[str], what: str) -> tuple[str, ...] | None:
    if v is None:
        return None
    out = (v,) if isinstance(v, str) else tuple(v)
    unknown = [x for x in out if x not in vocabulary]
    if unknown:
        raise RuleError(f"{what}: unknown value {unknown[0]!r}")
    return out


_PATTERNS = {"path", "pathNot", "exoticRequire", "exoticRequireNot", "license", "licenseNot", "namespace", "namespaceNot", "project", "projectNot", "assembly", "assemblyNot", "modulesNot", "chainsThrough"}


def _fill(kind: type, d: Mapping, skip: Sequence[str] = ()) -> dict:
    """Keyword arguments of a plain restriction; patterns are joined and checked."""
    names = {f.name for f in fields(kind)}
    out = {}
    for k, v in d.items():
        if k in skip:
            continue
        if k not in names:
            raise RuleError(f"unknown key {k!r}")
        if k in _PATTERNS:
            v = regex.join(v)
            if v:
                try:
                    regex.to_java(v)
                except regex.PatternError as e:
                    raise RuleError(str(e)) from e
        elif k.startswith("dependencyTypes"):
            v = _list(v, DEPENDENCY_TYPES, k)
        elif k.startswith("dependencyKind"):
            v = _list(v, DEPENDENCY_KINDS, k)
        elif k == "language":
            v = _list(v, LANGUAGES, k)
        out[k] = v
    return out


_CROSS = [f.name for f in fields(Cross)]


def _cross(d: Mapping) -> Cross:
    return Cross(**_fill(Cross, {k: v for k, v in d.items() if k in _CROSS}))


def _to(d: Mapping) -> To:
    d = dict(d)
    via = Via(**_fill(Via, _as_via(d.pop("via")))) if d.get("via") is not None else None
    only = Via(**_fill(Via, _as_via(d.pop("viaOnly")))) if d.get("viaOnly") is not None else None
    # viaNot and viaSomeNot fold into the two forms unless those say it already
    if (x := regex.join(d.pop("viaNot", None))) is not None:
        only = only or Via()
        only = only if only.pathNot else replace(only, pathNot=x)
    if (x := regex.join(d.pop("viaSomeNot", None))) is not None:
        via = via or Via()
        via = via if via.pathNot else replace(via, pathNot=x)
    return To(**_fill(To, {k: v for k, v in d.items() if k not in (*_CROSS, "via", "viaOnly")}), via=via, viaOnly=only, cross=_cross(d))


def _as_via(v: object) -> Mapping:
    return v if isinstance(v, Mapping) else {"path": v}


def _view(d: Mapping) -> GraphView:
    ignore = tuple((regex.join(e.get("from")), regex.join(e.get("to"))) for e in d.get("ignore", ()))
    redirect = tuple((regex.join(e["to"]), e["into"]) for e in d.get("redirect", ()))
    return GraphView(**_fill(GraphView, {k: v for k, v in d.items() if k not in ("ignore", "redirect")}), ignore=ignore, redirect=redirect)


def rule(d: Mapping) -> Rule:
    """One rule from its mapping."""
    plain = {k: d[k] for k in ("name", "severity", "comment", "fix", "owner", "since", "deprecated", "replacedBy", "allowEmpty", "examples", "scope") if d.get(k) is not None}
    if plain.get("severity", "warn") not in ("error", "warn", "info", "ignore"):
        raise RuleError(f"unknown severity {plain['severity']!r}")
    known = {"name", "severity", "comment", "fix", "owner", "since", "deprecated", "replacedBy", "allowEmpty", "examples", "scope", "from", "to", "module", "graph", "expires"}
    if extra := set(d) - known:
        raise RuleError(f"unknown key {sorted(extra)[0]!r} in rule {d.get('name', 'unnamed')!r}")
    frm = d.get("from") or {}
    expires = d.get("expires")
    return Rule(
        **plain,
        expires=date.fromisoformat(expires) if isinstance(expires, str) else expires,
        from_=From(**_fill(From, {k: v for k, v in frm.items() if k not in _CROSS}), cross=_cross(frm)),
        to=_to(d.get("to") or {}),
        module=Module(**_fill(Module, d["module"])) if d.get("module") is not None else None,
        graph=_view(d["graph"]) if d.get("graph") else None,
    )


def expand_layers(d: Mapping) -> list[dict]:
    """Each layer may not depend on a higher one: n layers give n(n-1)/2 rules (V18). Layers are listed from the highest on."""
    layers = d["layers"]
    carry = {k: d[k] for k in ("comment", "fix", "since", "deprecated", "replacedBy", "allowEmpty", "graph") if d.get(k)}
    out = []
    for low in range(1, len(layers)):
        for high in range(low):
            lo, hi = layers[low], layers[high]
            out.append({"name": f"{d['name']}:{lo['name']}-to-{hi['name']}", "severity": d.get("severity", "error"), "from": {"path": lo["path"]}, "to": {"path": hi["path"]}, **carry})
    return out


def expand_independence(d: Mapping) -> dict:
    """Modules that one capturing group names may not depend on one another."""
    p = d["pattern"]
    if len(regex.groups(p)) != 1:
        raise RuleError(f"independence {d['name']!r}: the pattern must have exactly one capturing group")
    start, end = _only_group(p)
    carry = {k: d[k] for k in ("comment", "fix", "since", "deprecated", "replacedBy", "allowEmpty", "graph") if d.get(k)}
    return {"name": d["name"], "severity": d.get("severity", "error"), "from": {"path": p}, "to": {"path": p, "pathNot": p[:start] + "$1" + p[end:]}, **carry}


def _only_group(p: str) -> tuple[int, int]:
    """Span of the one capturing group."""
    depth, start, opened, i = 0, -1, -1, 0
    while i < len(p):
        if p[i] == "\\":
            i += 1
        elif p[i] == "[":
            i = p.index("]", i + 2)
        elif p[i] == "(":
            if start < 0 and (p[i + 1 : i + 2] != "?" or p[i + 2 : i + 3] == "<"):
                start, opened = i, depth
            depth += 1
        elif p[i] == ")":
            depth -= 1
            if start >= 0 and depth == opened:
                return start, i + 1
        i += 1
    raise RuleError(f"unbalanced pattern {p!r}")


def load(config: Mapping | str, defines: Mapping[str, str] | None = None) -> RuleSet:
    """A rule set from a mapping, or from JSON or YAML text; shorthands expanded, ``ignore`` rules dropped."""
    if isinstance(config, str):
        config = parse(config)
    config = dict(config.get("rules", config) if isinstance(config.get("rules", None), Mapping) else config)
    if defines:
        config = substitute(config, defines)
    forbidden = [rule(r) for r in config.get("forbidden", ())]
    for d in config.get("layers", ()):
        forbidden += [rule(r) for r in expand_layers(d)]
    forbidden += [rule(expand_independence(d)) for d in config.get("independence", ())]
    required = [rule(r) for r in config.get("required", ())]
    severity, allowed = None, []
    if "allowed" in config:
        severity = config.get("allowedSeverity", "warn")
        if severity == "ignore":
            severity = None
        else:
            allowed = [replace(rule(r), name="not-in-allowed") for r in config["allowed"]]
    for r in [*allowed, *required]:
        if r.graph:
            raise RuleError(f"rule {r.name!r}: only forbidden rules may narrow the graph")
    ratchets = [Ratchet(r["name"], rule(r).from_, rule(r).to, r.get("max")) if "max" not in r else Ratchet(r["name"], rule({k: v for k, v in r.items() if k != "max"}).from_, rule({k: v for k, v in r.items() if k != "max"}).to, r["max"]) for r in config.get("ratchets", ())]
    keep = lambda rs: tuple(r for r in rs if r.severity != "ignore")
    return RuleSet(keep(forbidden), tuple(allowed), severity, keep(required), tuple(ratchets))


def parse(text: str) -> dict:
    """JSON, or YAML where its parser is installed."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise RuleError("not JSON, and no YAML parser is installed") from e
        return yaml.safe_load(text)


def substitute(value: object, defines: Mapping[str, str]) -> object:
    """``{{name}}`` in any string becomes the defined value."""
    if isinstance(value, str):
        return re.sub(r"\{\{\s*([\w.-]+)\s*\}\}", lambda m: str(defines.get(m.group(1), m.group(0))), value)
    if isinstance(value, Mapping):
        return {k: substitute(v, defines) for k, v in value.items()}
    return [substitute(v, defines) for v in value] if isinstance(value, (list, tuple)) else value


def extend(base: Mapping, own: Mapping) -> dict:
    """A rule file over the one it extends: rules of one name are merged key by key, others added (U4)."""
    out = {**base, **own}
    for family in ("forbidden", "required"):
        merged = {r.get("name", f"unnamed-{i}"): dict(r) for i, r in enumerate(base.get(family, ()))}
        for i, r in enumerate(own.get(family, ())):
            merged.setdefault(r.get("name", f"own-{i}"), {}).update(r)
        if merged:
            out[family] = list(merged.values())
    if base.get("allowed") or own.get("allowed"):
        seen: list = []
        for r in [*base.get("allowed", ()), *own.get("allowed", ())]:
            if r not in seen:
                seen.append(r)
        out["allowed"] = seen
    out["options"] = {**base.get("options", {}), **own.get("options", {})}
    return out


def glob_rule(name: str, source: str, target: str, severity: str = "error") -> dict:
    """Draft of a forbidden rule from two globs (Q21)."""
    return {"name": name, "severity": severity, "from": {"path": regex.glob_to_pattern(source)}, "to": {"path": regex.glob_to_pattern(target)}}


def refuse_unrecorded(rules: RuleSet, languages: Sequence[str]) -> list[str]:
    """Rules that narrow by a property which no language they can select records."""
    out = []
    for r in rules.all():
        for side, keys in (("from", r.from_.cross), ("to", r.to.cross)):
            can = [x for x in languages if keys.language is None or x in keys.language]
            for k in keys.given():
                base = k.removesuffix("Not")
                if base in RECORDED and any(x not in RECORDED[base] for x in can):
                    out.append(f"{r.name}: {side}.{k} is not recorded for {', '.join(x for x in can if x not in RECORDED[base])}")
    return out


def lint(rules: RuleSet) -> list[tuple[str, str]]:
    """Lifecycle and shape findings that need no graph (Q22, Q31): (rule, finding)."""
    from depweave.functions.order import precedence

    out: list[tuple[str, str]] = []
    names = {r.name for r in rules.all()}
    seen: set[str] = set()
    for r in [*rules.forbidden, *rules.required]:
        if r.name in seen and r.name != "unnamed":
            out.append((r.name, "duplicate-name"))
        seen.add(r.name)
        if r.replacedBy is not None and r.replacedBy == r.name:
            out.append((r.name, "replaced-by-self"))
        elif r.replacedBy is not None and r.replacedBy not in names:
            out.append((r.name, "replaced-by-unknown"))
        if r.since and r.deprecated and precedence(r.since, r.deprecated) > 0:
            out.append((r.name, "since-after-deprecated"))
    if any(r.from_ == From() and r.to == To() and r.module is None for r in rules.allowed):
        out.append(("not-in-allowed", "allowed-admits-everything"))
    return out


def repeats(rules: RuleSet) -> list[tuple[str, str]]:
    """Rules whose restrictions an earlier one of their family has (Q22): they can't add a finding, or admit nothing more."""
    out = []
    for family, finding in (("forbidden", "shadowed"), ("required", "shadowed"), ("allowed", "overlapping-allowed")):
        seen: list[tuple] = []
        for r in getattr(rules, family):
            body = (r.scope, r.from_, r.to, r.module, r.graph)
            if body in seen:
                out.append((r.name, finding))
            seen.append(body)
    return out
