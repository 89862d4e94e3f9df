"""Element rules over the code layer: selectors, the condition vocabulary, verdicts.

Every condition is a boolean column on the selected kind's table. Conditions
about sets (dependencies, calls, attributes, members) are computed once as key
tables and joined as flags; negation is of the flag, so nulls never leak.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.functions import regex
from depweave.operators.graph import Graph, complete

TYPE = {
    "fullName": "string", "name": "string", "namespaces": "array<string>", "kind": "string", "visibility": "string", "assembly": "string", "language": "string", "files": "array<string>",
    "abstract": "boolean", "sealed": "boolean", "record": "boolean", "static": "boolean", "generic": "boolean", "nested": "boolean", "immutable": "boolean", "referenced": "boolean",
    "baseType": "string", "baseTypes": "array<string>", "interfaces": "array<string>",
}
MEMBER = {
    "fullName": "string", "name": "string", "kind": "string", "visibility": "string", "declaringType": "string", "language": "string", "static": "boolean", "readOnly": "boolean", "virtual": "boolean", "abstract": "boolean", "sealed": "boolean",
    "returnType": "string", "getter": "string", "setter": "string", "initSetter": "string",
}
DEPENDENCY = {"source": "string", "target": "string", "kind": "string", "form": "string", "member": "string"}
ATTRIBUTE = {"target": "string", "attributeType": "string", "arguments": "array<string>", "namedArguments": "array<struct<name:string,value:string>>"}
CALL = {"from": "string", "to": "string"}

# Which kinds of types and members a selector takes.
TYPE_KINDS = {"class": ("class", "attribute"), "interface": ("interface",), "attribute": ("attribute",), "function": ("function",)}
MEMBER_KINDS = {"member": None, "field": ("field",), "method": ("method", "constructor"), "property": ("property",)}
TYPES, MEMBERS = ("type", "class", "interface", "attribute"), ("member", "field", "method", "property")
DECLARED = (*TYPES, "function", *MEMBERS)
# Concepts by the kinds that can answer them (E10, E15); those not listed are for every kind.
APPLIES = {
    DECLARED: ("public", "private", "protected", "internal", "protectedInternal", "privateProtected", "haveAssemblyQualifiedName", "haveAssemblyQualifiedNameMatching", "haveAssemblyQualifiedNameStartingWith", "haveAssemblyQualifiedNameEndingWith", "haveAssemblyQualifiedNameContaining", "resideInAssembly", "resideInAssemblyMatching", "haveAnyAttributes", "onlyHaveAttributes", "haveAttributeWithArguments", "haveAttributeWithNamedArguments", "haveAnyAttributesWithArguments", "haveAnyAttributesWithNamedArguments", "callAny",),
    TYPES: ("assignableTo", "implementInterface", "implementAnyInterfaces", "enums", "structs", "valueTypes", "nested", "nestedIn", "haveMemberWithName", "haveFieldMemberWithName", "haveMethodMemberWithName", "havePropertyMemberWithName", "generic",),
    ("type", "class", "attribute"): ("sealed", "record",),
    (*TYPES, "member", "method", "property"): ("abstract",),
    (*TYPES, *MEMBERS): ("static", "immutable",),
    MEMBERS: ("declaredIn",),
    ("member", "field", "property"): ("readOnly",),
    ("member", "method", "property"): ("virtual",),
    ("member", "method"): ("constructor", "haveReturnType", "haveDependencyInMethodBodyTo",),
    ("member", "method", "field", "property"): ("calledBy",),
    (*TYPES, "function"): ("adhereToPlantUmlDiagram",),
}
KINDS_OF = {concept: kinds for kinds, concepts in APPLIES.items() for concept in concepts}
ACCESSOR_KINDS = ("member", "property")
_ASSEMBLIES = ("haveAssemblyQualifiedName", "haveAssemblyQualifiedNameMatching", "haveAssemblyQualifiedNameStartingWith", "haveAssemblyQualifiedNameEndingWith", "haveAssemblyQualifiedNameContaining", "resideInAssembly", "resideInAssemblyMatching")
_SCRIPT = (
    "protectedInternal", "privateProtected", *_ASSEMBLIES, "structs", "valueTypes", "sealed", "record", "virtual", "haveInitOnlySetter",
    "haveInternalGetter", "haveProtectedInternalGetter", "havePrivateProtectedGetter", "haveInternalSetter", "haveProtectedInternalSetter", "havePrivateProtectedSetter",
)
# What a language has no answer to (E14); .NET has one to everything.
UNANSWERABLE = {
    "typescript": _SCRIPT,
    "javascript": _SCRIPT,
    "python": (
        "protected", "internal", "protectedInternal", "privateProtected", *_ASSEMBLIES, "enums", "structs", "valueTypes", "sealed", "record", "generic", "virtual", "haveReturnType", "haveDependencyInMethodBodyTo", "callAny", "calledBy",
        "haveInitOnlySetter", "havePublicGetter", "haveProtectedGetter", "haveInternalGetter", "haveProtectedInternalGetter", "havePrivateGetter", "havePrivateProtectedGetter",
        "havePublicSetter", "haveProtectedSetter", "haveInternalSetter", "haveProtectedInternalSetter", "havePrivateSetter", "havePrivateProtectedSetter",
    ),
}
VISIBILITIES = {"public": "public", "private": "private", "protected": "protected", "internal": "internal", "protectedInternal": "protected-internal", "privateProtected": "private-protected"}


class ElementError(ValueError):
    """A condition that the vocabulary does not have, or that a kind cannot answer."""


@dataclass(frozen=True)
class Code:
    """The code layer."""

    types: DataFrame
    members: DataFrame
    dependencies: DataFrame
    attributes: DataFrame
    calls: DataFrame
    graph: Graph | None = None

    @staticmethod
    def of(
        types: DataFrame, members: DataFrame | None = None, dependencies: DataFrame | None = None, attributes: DataFrame | None = None, calls: DataFrame | None = None, graph: Graph | None = None
    ) -> "Code":
        spark = types.sparkSession
        empty = lambda cols: spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in cols.items()))
        put = lambda df, cols: empty(cols) if df is None else complete(df, cols)
        return Code(complete(types, TYPE), put(members, MEMBER), put(dependencies, DEPENDENCY), put(attributes, ATTRIBUTE), put(calls, CALL), graph)


def select(code: Code, kind: str, referenced: bool = False, language: str | None = None) -> DataFrame:
    """Elements of a kind (E2, E3) with ``key_`` and what conditions read."""
    if kind == "type" or kind in TYPE_KINDS:
        t = code.types.where(F.col("kind") != "function") if kind == "type" else code.types.where(F.col("kind").isin(*TYPE_KINDS[kind]))
        if not referenced:
            t = t.where(~F.coalesce("referenced", F.lit(False)))
    elif kind in MEMBER_KINDS:
        t = code.members if MEMBER_KINDS[kind] is None else code.members.where(F.col("kind").isin(*MEMBER_KINDS[kind]))
        owner = code.types.select(F.col("fullName").alias("declaringType"), "namespaces", "assembly", "files")
        t = t.join(owner, "declaringType", "left")
    elif kind == "module" and code.graph is not None:
        m = code.graph.modules.where(~F.coalesce("coreModule", F.lit(False)) & ~F.coalesce("couldNotResolve", F.lit(False)))
        t = m.select(F.col("source").alias("fullName"), F.regexp_extract("source", "[^/]+$", 0).alias("name"), F.array("source").alias("namespaces"), "language", F.array("source").alias("files"))
    else:
        raise ElementError(f"unknown kind {kind!r}")
    if language:
        t = t.where(F.col("language") == language)
    return t.withColumn("key_", F.col("fullName"))


def _flag(df: DataFrame, keys: DataFrame, name: str, on: str = "key_") -> DataFrame:
    """``df`` with a boolean column: whether its ``on`` is among ``keys`` (key)."""
    return df.join(keys.select(F.col("key").alias(on)).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _lower_in(c: Column, names: list[str]) -> Column:
    return F.coalesce(F.lower(c).isin([n.lower() for n in names]), F.lit(False))


def _any(c: Column, names: list[str], test: Callable[[Column, str], Column], fold: bool) -> Column:
    return F.coalesce(regex.any_of([test(F.lower(c) if fold else c, n.lower() if fold else n) for n in names]), F.lit(False))


def _attribute_args(df: DataFrame, instances: DataFrame, wanted: list, named: bool, name: str) -> DataFrame:
    """Positive, one instance has all wanted values; negative, no instance has any. The latter under ``name`` + ``_not``."""
    arr = F.col("namedArguments") if named else F.col("arguments")
    arr = F.coalesce(arr, F.array().cast("array<struct<name:string,value:string>>" if named else "array<string>"))
    has = lambda w: F.exists(arr, (lambda x: (x["name"] == w[0]) & (x["value"] == w[1])) if named else (lambda x: x == w))
    every, some = F.lit(True), F.lit(False)
    for w in wanted:
        every, some = every & has(w), some | has(w)
    per = instances.groupBy(F.col("target").alias("key_")).agg(F.bool_or(every).alias(name), F.bool_or(some).alias("some_"))
    out = df.join(per, "key_", "left")
    return out.withColumn(name, F.coalesce(name, F.lit(False))).withColumn(name + "_not", ~F.coalesce("some_", F.lit(False))).drop("some_")


class Conditions:
    """Adds one flag column per test to a selection; ``column`` is the flag of a test."""

    def __init__(self, code: Code, df: DataFrame, kind: str):
        self.code, self.df, self.kind, self.count = code, df, kind, 0
        self.languages: set[str] | None = None
        self.is_type = kind == "type" or kind in TYPE_KINDS

    def keys(self, operand: object) -> DataFrame:
        """(key) of names or of a nested selector (E4); an unknown name is an error."""
        if isinstance(operand, Mapping):
            sel = operand.get("select", operand)
            return matching(self.code, sel).select(F.col("key_").alias("key"))
        names = [operand] if isinstance(operand, str) else list(operand)
        spark = self.df.sparkSession
        wanted = spark.createDataFrame([(n,) for n in names], "key string")
        known = self.code.types.select(F.col("fullName").alias("key")).unionByName(self.code.members.select(F.col("fullName").alias("key")))
        if self.code.graph is not None:
            known = known.unionByName(self.code.graph.modules.select(F.col("source").alias("key")))
        missing = wanted.join(known, "key", "left_anti").collect()
        if missing:
            raise ElementError(f"unknown element {missing[0][0]!r}")
        return wanted

    def _new(self) -> str:
        self.count += 1
        return f"c{self.count}_"

    def _set(self, keys: DataFrame) -> Column:
        n = self._new()
        self.df = _flag(self.df, keys, n)
        return F.col(n)

    def _own(self, links: DataFrame) -> DataFrame:
        """(source, target) links of the selected elements: of a type its members' too."""
        l_ = links.select("source", "target")
        if self.kind == "module":
            return self.code.graph.edges.select("source", F.col("resolved").alias("target"))
        if not self.is_type:
            return l_
        via = l_.join(self.code.members.select(F.col("fullName").alias("source"), "declaringType"), "source").select(F.col("declaringType").alias("source"), "target")
        return l_.unionByName(via)

    def test(self, concept: str, value: object) -> tuple[Column, Column | None]:
        """(positive, its own negative if that is not the complement) of one condition."""
        c, code, names = concept, self.code, [value] if isinstance(value, str) else value
        kinds = ACCESSOR_KINDS if c.endswith(("Getter", "Setter")) else KINDS_OF.get(c)
        if kinds is not None and self.kind not in kinds:
            raise ElementError(f"{c!r} does not apply to {self.kind!r}")
        if any(c in cant for cant in UNANSWERABLE.values()):
            if self.languages is None:  # of what is selected: as many rows as there are languages
                self.languages = {r[0] for r in self.df.select("language").distinct().collect()}
            for language in sorted(self.languages & set(UNANSWERABLE)):
                if c in UNANSWERABLE[language]:
                    raise ElementError(f"{language} has no answer to {c!r}")
        name, key = F.col("name"), F.col("key_")
        truth = lambda col: F.coalesce(F.col(col), F.lit(False)) == F.lit(value if isinstance(value, bool) else True)
        yes = lambda e: F.coalesce(e, F.lit(False)) == F.lit(value if isinstance(value, bool) else True)
        if c == "are":
            return self._set(self.keys(value)), None
        if c in VISIBILITIES:
            return yes(F.col("visibility") == VISIBILITIES[c]), None
        for stem, col, fold in (("haveName", name, False), ("haveFullName", key, True), ("haveAssemblyQualifiedName", F.concat_ws(", ", key, F.col("assembly")) if "assembly" in self.df.columns else key, True)):
            if c == stem:
                return _lower_in(col, names), None
            if c == stem + "Matching":
                return regex.matches(col, regex.join(value)), None
            if c == stem + "StartingWith":
                return _any(col, names, lambda a, n: a.startswith(n), fold), None
            if c == stem + "EndingWith":
                return _any(col, names, lambda a, n: a.endswith(n), fold), None
            if c == stem + "Containing":
                return _any(col, names, lambda a, n: a.contains(n), fold), None
        if c == "resideInNamespace":
            return F.coalesce(F.exists("namespaces", lambda x: F.lower(x).isin([n.lower() for n in names])), F.lit(False)), None
        if c == "resideInNamespaceMatching":
            return F.coalesce(F.exists("namespaces", lambda x: regex.matches(x, regex.join(value))), F.lit(False)), None
        if c == "resideInAssembly":
            return _lower_in(F.col("assembly"), names) | _lower_in(F.split("assembly", ",")[0], names), None
        if c == "resideInAssemblyMatching":
            return regex.matches(F.col("assembly"), regex.join(value)), None
        if c == "dependOnAny":
            return self._set(self._own(code.dependencies).join(self.keys(value), F.col("target") == F.col("key")).select(F.col("source").alias("key"))), None
        if c == "onlyDependOn":
            analysed = code.graph.modules.where(~F.coalesce("coreModule", F.lit(False)) & ~F.coalesce("couldNotResolve", F.lit(False))).select(F.col("source").alias("target")) if self.kind == "module" else code.types.where(~F.coalesce("referenced", F.lit(False))).select(F.col("fullName").alias("target"))
            outside = self._own(code.dependencies).where("source != target").join(analysed, "target", "left_semi").join(self.keys(value).select(F.col("key").alias("target")), "target", "left_anti")
            return ~self._set(outside.select(F.col("source").alias("key"))), None
        if c == "callAny":
            return self._set(self._own(code.calls.select(F.col("from").alias("source"), F.col("to").alias("target"))).join(self.keys(value), F.col("target") == F.col("key")).select(F.col("source").alias("key"))), None
        if c == "calledBy":
            by = code.calls.join(code.members.select(F.col("fullName").alias("from"), F.col("declaringType").alias("by")), "from")
            return self._set(by.join(self.keys(value), F.col("by") == F.col("key")).select(F.col("to").alias("key"))), None
        if c == "haveAnyAttributes":
            return self._set(code.attributes.join(self.keys(value), F.col("attributeType") == F.col("key")).select(F.col("target").alias("key"))), None
        if c == "onlyHaveAttributes":
            return ~self._set(code.attributes.join(self.keys(value).select(F.col("key").alias("attributeType")), "attributeType", "left_anti").select(F.col("target").alias("key"))), None
        if c in ("haveAttributeWithArguments", "haveAttributeWithNamedArguments", "haveAnyAttributesWithArguments", "haveAnyAttributesWithNamedArguments"):
            named, n = "Named" in c, self._new()
            inst = code.attributes if "Any" in c else code.attributes.where(F.col("attributeType") == value["attribute"])
            wanted = value if "Any" in c else value["arguments"]
            wanted = [(k, v) for k, v in wanted.items()] if isinstance(wanted, Mapping) else list(wanted)
            self.df = _attribute_args(self.df, inst, wanted, named, n)
            return F.col(n), F.col(n + "_not")
        if c == "assignableTo":
            own = code.types.select("fullName", F.explode(F.array_compact(F.concat(F.array("fullName", "baseType"), F.coalesce("baseTypes", F.array().cast("array<string>")), F.coalesce("interfaces", F.array().cast("array<string>"))))).alias("up"))
            return self._set(own.join(self.keys(value), F.col("up") == F.col("key")).select(F.col("fullName").alias("key"))), None
        if c == "implementInterface":
            if not isinstance(value, Mapping):
                return F.coalesce(F.exists("interfaces", lambda x: x.isin(names)), F.lit(False)), None
            listed = code.types.select("fullName", F.explode("interfaces").alias("i")).join(self.keys(value), F.col("i") == F.col("key"))
            return self._set(listed.select(F.col("fullName").alias("key"))), None
        if c == "implementAnyInterfaces":
            keys = self.keys(value)
            some = not keys.isEmpty()
            has = self._set(code.types.select("fullName", F.explode("interfaces").alias("i")).join(keys, F.col("i") == F.col("key")).select(F.col("fullName").alias("key")))
            return has & F.lit(some), ~has & F.lit(some)
        if c in ("enums", "structs", "valueTypes"):
            return yes(F.col("kind").isin(*{"enums": ("enum",), "structs": ("struct",), "valueTypes": ("enum", "struct")}[c])), None
        if c == "nestedIn":
            outer = self.keys(value)
            up = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("fullName", r"\+"))), lambda i: F.array_join(F.slice(F.split("fullName", r"\+"), 1, i), "+")))
            ups = code.types.select("fullName", up.alias("up")).where("up != fullName")
            return self._set(ups.join(outer, F.col("up") == F.col("key")).select(F.col("fullName").alias("key"))), None
        for stem, kinds in (("haveMemberWithName", None), ("haveFieldMemberWithName", ("field",)), ("haveMethodMemberWithName", ("method", "constructor")), ("havePropertyMemberWithName", ("property",))):
            if c == stem:
                m = code.members if kinds is None else code.members.where(F.col("kind").isin(*kinds))
                return self._set(m.where(_lower_in(F.col("name"), names)).select(F.col("declaringType").alias("key"))), None
        if c == "immutable":
            m = code.members.where(~F.coalesce("static", F.lit(False)) & F.col("kind").isin("field", "property"))
            loose = m.where(F.when(F.col("kind") == "field", ~F.coalesce("readOnly", F.lit(False))).otherwise(F.col("setter").isNotNull()))
            return yes(F.coalesce(F.col("immutable"), ~self._set(loose.select(F.col("declaringType").alias("key"))))), None
        if c == "readOnly":
            return yes(F.when(F.col("kind") == "field", F.coalesce("readOnly", F.lit(False))).when(F.col("kind") == "property", F.col("setter").isNull() & F.col("initSetter").isNull())), None
        if c in ("abstract", "sealed", "record", "generic", "static", "nested", "virtual"):
            if c not in self.df.columns:
                raise ElementError(f"{self.kind} has no {c!r}")
            return truth(c), None
        if c == "constructor":
            return yes(F.col("kind") == "constructor"), None
        if c == "declaredIn":
            n = self._new()
            self.df = _flag(self.df, self.keys(value), n, "declaringType")
            return F.col(n), None
        if c == "haveReturnType":
            n, m = self._new(), self._new()
            self.df = _flag(self.df.withColumn("g_", F.split_part("returnType", F.lit("<"), F.lit(1))), self.keys(value), n, "returnType")
            self.df = _flag(self.df, self.keys(value), m, "g_").drop("g_")
            return F.col(n) | F.col(m), None
        if c == "haveDependencyInMethodBodyTo":
            d = code.dependencies.where("kind = 'body' and form = 'body-type'").select(F.coalesce("member", "source").alias("source"), "target")
            return self._set(d.join(self.keys(value), F.col("target") == F.col("key")).select(F.col("source").alias("key"))), None
        if c == "adhereToPlantUmlDiagram":
            from depweave.operators import diagrams

            t = code.types.select(F.col("fullName").alias("type"), F.explode("namespaces").alias("namespace"))
            judged = diagrams.adherence(t, code.dependencies.select("source", "target"), diagrams.parse(value))
            return ~self._set(judged.where("not passed").select(F.col("type").alias("key"))), None
        setter = F.coalesce("setter", "initSetter") if "setter" in self.df.columns else None
        if c == "haveGetter":
            return yes(F.col("getter").isNotNull()), None
        if c == "haveSetter":
            return yes(setter.isNotNull()), None
        if c == "haveInitOnlySetter":
            return yes(F.col("initSetter").isNotNull()), None
        for v, stored in VISIBILITIES.items():
            cap = v[0].upper() + v[1:]
            if c == f"have{cap}Getter":
                return yes(F.col("getter") == stored), None
            if c == f"have{cap}Setter":
                return yes(setter == stored), None
        raise ElementError(f"unknown condition {concept!r}")

    def expression(self, x: object) -> Column:
        """all, any, not over tests (E5, E9, E17); several keys of a mapping are a conjunction."""
        if isinstance(x, list):
            out = F.lit(True)
            for y in x:
                out = out & self.expression(y)
            return out
        out = F.lit(True)
        for k, v in x.items():
            if k == "all":
                out = out & self.expression(list(v))
            elif k == "any":
                out = out & regex.any_of([self.expression(y) for y in v])
            elif k == "not":
                out = out & ~self.expression(v)
            else:
                concept, negated = concept_of(k)
                pos, neg = self.test(concept, v)
                out = out & ((neg if neg is not None else ~pos) if negated else pos)
        return out


# Concepts and the stems that their keys are written with.
PLAIN = set("""are public private protected internal protectedInternal privateProtected enums structs valueTypes nested nestedIn abstract sealed record immutable generic declaredIn static readOnly constructor virtual assignableTo calledBy""".split())


def concept_of(key: str) -> tuple[str, bool]:
    """Concept and negation of a written key (E9): ``beAbstract``, ``notBePublic``, ``areNotSealed``, ``doNotHaveName``, ``notDependOnAny``, ``...That``."""
    k = key.removesuffix("That")
    if k in ("be", "are"):
        return "are", False
    if k in ("notBe", "areNot"):
        return "are", True
    for stem, negated in (("areNot", True), ("notBe", True), ("doNot", True), ("are", False), ("be", False), ("not", True)):
        rest = k.removeprefix(stem)
        if rest != k and rest[:1].isupper():
            low = rest[0].lower() + rest[1:]
            return low, negated
    return k, False


def matching(code: Code, sel: Mapping) -> DataFrame:
    """The elements a selector takes (E3); nested selectors include referenced ones."""
    cond = Conditions(code, select(code, sel["kind"], sel.get("includeReferenced", True), sel.get("language")), sel["kind"])
    where = cond.expression(sel["where"]) if sel.get("where") else F.lit(True)
    return cond.df.where(where)


def evaluate(code: Code, rule: Mapping) -> tuple[DataFrame, bool]:
    """(key, passed) per selected object and whether the selection is empty.

    Objects of equal key pass only if all do. ``exist`` holds for what was
    selected and decides an empty selection.
    """
    sel = rule["select"]
    base = Conditions(code, select(code, sel["kind"], sel.get("includeReferenced", False), sel.get("language")), sel["kind"])
    where = base.expression(sel["where"]) if sel.get("where") else F.lit(True)
    base.df = base.df.where(where)
    should = dict(rule["should"])
    exist = should.pop("exist", None)
    not_exist = should.pop("notExist", None)
    passed = base.expression(should) if should else F.lit(True)
    if exist is False or not_exist:
        passed = F.lit(False)
    out = base.df.withColumn("passed", passed).groupBy(F.col("key_").alias("key")).agg(F.bool_and("passed").alias("passed"))
    return out, out.isEmpty()


def findings(code: Code, rule: Mapping, name: str, severity: str = "warn") -> DataFrame:
    """Failed objects as findings from their first file, or their own key."""
    from depweave.operators.evaluate import violation_id

    bad = evaluate(code, rule)[0].where("not passed").select("key")
    files = code.types.select(F.col("fullName").alias("key"), F.array_min("files").alias("file")).unionByName(code.members.join(code.types.select(F.col("fullName").alias("declaringType"), F.array_min("files").alias("file")), "declaringType").select(F.col("fullName").alias("key"), "file"))
    if code.graph is not None:
        files = files.unionByName(code.graph.modules.select(F.col("source").alias("key"), F.col("source").alias("file")))
    first = files.groupBy("key").agg(F.min("file").alias("file"))
    j = bad.join(first, "key", "left").select(F.coalesce("file", "key").alias("from"), F.col("key").alias("to"))
    return j.select(F.lit("element").alias("type"), F.lit(name).alias("rule"), F.lit(severity).alias("severity"), "from", "to", violation_id(F.lit(name), F.col("from"), F.col("to"), F.lit("")).alias("id"))
