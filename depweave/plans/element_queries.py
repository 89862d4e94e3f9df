"""Queries over the code layer, one for each condition of element rules, with their SQL.

The layer is derived from the parts table so that every property takes all its
values: ``rich_layer`` and ``RICH_SQL`` say the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.operators import diagrams, elements, slices as sl
from depweave.operators.elements import Code
from depweave.sources.views import code_graph, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

VISIBLE = ("public", "private", "protected", "internal", "protected-internal", "private-protected")
_VIS = "list_extract(['public','private','protected','internal','protected-internal','private-protected'], CAST(({0}) % 6 AS INT) + 1)"


def _visible(n: F.Column) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in VISIBLE]), (n % 6).cast("int"))


def rich_layer(spark: SparkSession, d: str) -> Code:
    """Types from parts, every tenth with a type nested in it; members, attributes, dependencies and calls of each."""
    k = F.col("k")
    p = table(spark, d, "part").where("p_partkey is not null").select(
        F.col("p_partkey").alias("k"), F.concat(F.lit("Shop."), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")).alias("ns"), F.concat(F.lit("Part"), "p_partkey").alias("name")
    )
    key = F.concat_ws(".", "ns", "name")
    kind = F.get(F.array(*[F.lit(x) for x in ("class", "interface", "struct", "enum")]), (k % 4).cast("int"))
    parts = p.select(
        key.alias("fullName"), "name", F.array("ns").alias("namespaces"), kind.alias("kind"), _visible(k).alias("visibility"), F.when(k % 2 == 0, "Shop, Version=1.0").otherwise("Store, Version=2.0").alias("assembly"),
        F.lit("dotnet").alias("language"), F.array(F.concat(F.lit("shop/"), "name", F.lit(".cs"))).alias("files"), (k % 7 == 0).alias("abstract"), (k % 5 == 0).alias("sealed"), (k % 11 == 0).alias("record"),
        (k % 13 == 0).alias("static"), (k % 9 == 0).alias("generic"), F.lit(False).alias("nested"), F.when(k % 8 == 0, True).alias("immutable"), F.when(k % 6 == 0, F.concat(F.lit("Base"), (k % 10).cast("string"))).alias("baseType"),
        F.when(k % 3 == 0, F.when(k % 2 == 0, F.array(F.lit("Shop.IA"), F.lit("Shop.IB"))).otherwise(F.array(F.lit("Shop.IA")))).alias("interfaces"), "k",
    )
    inner = parts.where("k % 10 = 9").select(
        F.concat("fullName", F.lit("+Inner")).alias("fullName"), F.lit("Inner").alias("name"), "namespaces", F.lit("class").alias("kind"), F.lit("private").alias("visibility"), "assembly", "language", "files", F.lit(True).alias("nested")
    )
    known = spark.createDataFrame([(n, n.split(".")[-1], c, True) for n, c in (("Shop.IA", "interface"), ("Shop.IB", "interface"), ("Tag", "attribute"), ("Mark", "attribute"))], "fullName string, name string, kind string, referenced boolean")
    types = parts.drop("k").unionByName(inner, allowMissingColumns=True).unionByName(known, allowMissingColumns=True)
    base = parts.select("fullName", "k")
    m = base.select(F.col("fullName").alias("declaringType"), "k", F.explode(F.array(*[F.lit(x) for x in ("Size", "Price", "Make", ".ctor")])).alias("name"))
    kinds = F.when(F.col("name") == "Size", "field").when(F.col("name") == "Price", "property").when(F.col("name") == "Make", "method").otherwise("constructor")
    price = F.col("name") == "Price"
    members = m.select(
        F.concat_ws("::", "declaringType", "name").alias("fullName"), "name", kinds.alias("kind"), _visible(k).alias("visibility"), "declaringType", F.lit("dotnet").alias("language"), (k % 13 == 0).alias("static"), (k % 2 == 0).alias("readOnly"),
        (k % 3 == 1).alias("virtual"), (k % 7 == 1).alias("abstract"), (k % 5 == 1).alias("sealed"), F.when(F.col("name") == "Make", F.when(k % 2 == 0, "Shop.IA").otherwise("Shop.IB<int>")).alias("returnType"),
        F.when(price & (k % 10 != 0), _visible(k)).alias("getter"), F.when(price & (k % 3 != 0), _visible(k + 1)).alias("setter"), F.when(price & (k % 6 == 0), _visible(k)).alias("initSetter"),
    )
    nxt = base.select(F.col("fullName").alias("target"), (F.col("k") - 3).alias("k"))
    deps = base.join(nxt, "k").select(F.col("fullName").alias("source"), "target", F.lit("body").alias("kind"), F.lit("body-type").alias("form"), F.when(k % 2 == 0, F.concat("fullName", F.lit("::Make"))).alias("member"))
    tag = base.where("k % 5 = 1").select(F.col("fullName").alias("target"), F.lit("Tag").alias("attributeType"), F.array((k % 4).cast("string")).alias("arguments"), F.array(F.struct(F.lit("level").alias("name"), (k % 3).cast("string").alias("value"))).alias("namedArguments"))
    mark = base.where("k % 5 = 2 or k % 10 = 1").select(F.col("fullName").alias("target"), F.lit("Mark").alias("attributeType"), F.array(F.lit("x")).alias("arguments"), F.lit(None).cast("array<struct<name:string,value:string>>").alias("namedArguments"))
    calls = base.join(nxt, "k").select(F.concat("fullName", F.lit("::Make")).alias("from"), F.concat("target", F.lit("::Price")).alias("to"))
    return Code.of(types, members, deps, tag.unionByName(mark), calls)


RICH_SQL = f"""b AS (SELECT p_partkey AS k, 'Shop.' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS ns, 'Part' || p_partkey AS name FROM part WHERE p_partkey IS NOT NULL),
 t0 AS (SELECT ns || '.' || name AS key, name, ns, k, list_extract(['class','interface','struct','enum'], CAST(k % 4 AS INT) + 1) AS kind, {_VIS.format('k')} AS vis, CASE WHEN k % 2 = 0 THEN 'Shop, Version=1.0' ELSE 'Store, Version=2.0' END AS asm,
  'dotnet' AS lang, k % 7 = 0 AS abstract, k % 5 = 0 AS sealed, k % 11 = 0 AS record, k % 13 = 0 AS static, k % 9 = 0 AS generic, false AS nested, k % 3 = 0 AS ia, k % 6 = 0 AS ib, k % 8 = 0 OR k % 13 = 0 OR k % 6 = 0 AS immutable FROM b),
 t AS (SELECT * FROM t0 UNION ALL SELECT key || '+Inner', 'Inner', ns, NULL, 'class', 'private', asm, lang, false, false, false, false, false, true, false, false, true FROM t0 WHERE k % 10 = 9),
 mb AS (SELECT key || '::' || n AS key, n AS name, key AS owner, t0.kind AS owner_kind, k, vis, static, k % 2 = 0 AS ro, k % 3 = 1 AS virt, k % 7 = 1 AS abstract, CASE n WHEN 'Size' THEN 'field' WHEN 'Price' THEN 'property' WHEN 'Make' THEN 'method' ELSE 'constructor' END AS kind,
  CASE WHEN n = 'Price' AND k % 10 != 0 THEN {_VIS.format('k')} END AS getter, CASE WHEN n = 'Price' AND k % 3 != 0 THEN {_VIS.format('k + 1')} END AS setter, CASE WHEN n = 'Price' AND k % 6 = 0 THEN {_VIS.format('k')} END AS init,
  ns, asm FROM t0, unnest(['Size', 'Price', 'Make', '.ctor']) u(n)),
 td AS (SELECT x.key AS source, y.key AS target, x.k, y.kind AS tkind, y.vis AS tvis, x.kind AS skind FROM t0 x JOIN t0 y ON y.k = x.k + 3)"""


def q(sql: str, name: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


def _rule(name: str, kind: str, should: dict, passed: str, where: dict | None = None, sql_where: str = "true", view: str | None = None, more: dict | None = None) -> None:
    """A rule over a kind of elements: its conditions and the SQL condition that holds for those that pass."""
    members = kind in elements.MEMBERS
    at = view or ("mb" if members else "t")
    of = {"type": "true", "member": "true", "method": "kind IN ('method', 'constructor')"}.get(kind, f"kind = '{kind}'")
    rule = {"select": {"kind": kind, **({"where": where} if where else {}), **(more or {})}, "should": should}

    @q(f"WITH {RICH_SQL} SELECT key, coalesce({passed}, false) AS passed FROM {at} WHERE {of} AND {sql_where}", name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return elements.evaluate(rich_layer(spark, d), rule)[0]


_IFACE = {"kind": "interface"}
_OPEN = {"kind": "type", "where": {"arePublic": True}}

_rule("c01_are", "type", {"be": {"kind": "class"}}, "kind = 'class'")
_rule("c01_are_not", "type", {"notBe": {"kind": "class"}}, "kind != 'class'")
_rule("c02_exist", "interface", {"notExist": True}, "false")
for _i, (_n, _v) in enumerate(zip(("public", "private", "protected", "internal", "protectedInternal", "privateProtected"), VISIBLE)):
    _cap = _n[0].upper() + _n[1:]
    _rule(f"c{3 + _i:02d}_{_n.lower()}", "type", {f"be{_cap}": True}, f"vis = '{_v}'")
    _rule(f"c{3 + _i:02d}_{_n.lower()}_members", "member", {f"notBe{_cap}": True}, f"vis != '{_v}'")
for _i, _n in enumerate(("public", "protected", "internal", "protectedInternal", "private", "privateProtected")):
    _cap, _v = _n[0].upper() + _n[1:], elements.VISIBILITIES[_n]
    _rule(f"c{65 + _i}_get_{_n.lower()}", "property", {f"have{_cap}Getter": True}, f"getter = '{_v}'")
    _rule(f"c{71 + _i}_set_{_n.lower()}", "property", {f"have{_cap}Setter": True}, f"coalesce(setter, init) = '{_v}'")
_rule("c09_name", "type", {"haveName": ["PART5", "inner"]}, "lower(name) IN ('part5', 'inner')")
_rule("c10_name_matching", "type", {"haveNameMatching": "^Part[0-9]*7$"}, "regexp_matches(name, '^Part[0-9]*7$')")
_rule("c11_name_starts", "member", {"haveNameStartingWith": ["P", "."]}, "starts_with(name, 'P') OR starts_with(name, '.')")
_rule("c12_name_ends", "type", {"haveNameEndingWith": ["3", "r"]}, "suffix(name, '3') OR suffix(name, 'r')")
_rule("c13_name_contains", "type", {"doNotHaveNameContaining": "t1"}, "NOT contains(name, 't1')")
_rule("c14_full_name", "type", {"haveFullName": ["shop.brand11.part9", "SHOP.BRAND13.PART1"]}, "lower(key) IN ('shop.brand11.part9', 'shop.brand13.part1')")
_rule("c15_full_name_matching", "type", {"haveFullNameMatching": "Brand[1-3]\\d\\.Part"}, "regexp_matches(key, 'Brand[1-3]\\d\\.Part')")
_rule("c16_full_name_starts", "type", {"haveFullNameStartingWith": "SHOP.brand2"}, "starts_with(lower(key), 'shop.brand2')")
_rule("c17_full_name_ends", "member", {"haveFullNameEndingWith": "1::PRICE"}, "suffix(lower(key), '1::price')")
_rule("c18_full_name_contains", "type", {"haveFullNameContaining": ["D3", "+in"]}, "contains(lower(key), 'd3') OR contains(lower(key), '+in')")
_AQ = "lower(key || ', ' || asm)"
_rule("c19_assembly_name", "type", {"haveAssemblyQualifiedName": "Shop.Brand11.Part9, Store, Version=2.0"}, f"{_AQ} = 'shop.brand11.part9, store, version=2.0'")
_rule("c20_assembly_name_matching", "type", {"haveAssemblyQualifiedNameMatching": "5, Sto"}, "regexp_matches(key || ', ' || asm, '5, Sto')")
_rule("c21_assembly_name_starts", "type", {"haveAssemblyQualifiedNameStartingWith": "shop.BRAND4"}, f"starts_with({_AQ}, 'shop.brand4')")
_rule("c22_assembly_name_ends", "member", {"haveAssemblyQualifiedNameEndingWith": "VERSION=2.0"}, f"suffix({_AQ}, 'version=2.0')")
_rule("c23_assembly_name_contains", "type", {"haveAssemblyQualifiedNameContaining": "7, SHOP"}, f"contains({_AQ}, '7, shop')")
_rule("c24_namespace", "type", {"resideInNamespace": ["shop.brand11", "Shop.Brand22"]}, "ns IN ('Shop.Brand11', 'Shop.Brand22')")
_rule("c25_namespace_matching", "member", {"resideInNamespaceMatching": "Brand.4$"}, "regexp_matches(ns, 'Brand.4$')")
_rule("c26_assembly", "type", {"resideInAssembly": "store"}, "starts_with(asm, 'Store')")
_rule("c27_assembly_matching", "type", {"doNotResideInAssemblyMatching": "=1"}, "NOT contains(asm, '=1')")
_rule("c28_depend_on_any", "type", {"dependOnAny": _IFACE}, "EXISTS (SELECT 1 FROM td WHERE td.source = t.key AND tkind = 'interface')")
_rule("c29_only_depend_on_public", "type", {"onlyDependOn": _OPEN}, "NOT EXISTS (SELECT 1 FROM td WHERE td.source = t.key AND tvis != 'public')")
_rule("c30_call_any", "type", {"callAny": {"kind": "property", "where": {"arePublic": True}}}, "EXISTS (SELECT 1 FROM td WHERE td.source = t.key AND tvis = 'public')")
_rule("c31_any_attributes", "type", {"haveAnyAttributes": ["Tag"]}, "k % 5 = 1")
_rule("c32_only_attributes", "type", {"onlyHaveAttributes": ["Tag"]}, "NOT coalesce(k % 5 = 2 OR k % 10 = 1, false)")
_rule("c33_attribute_with_arguments", "type", {"haveAttributeWithArguments": {"attribute": "Tag", "arguments": ["1"]}}, "k % 5 = 1 AND k % 4 = 1")
_rule("c34_attribute_with_named", "type", {"haveAttributeWithNamedArguments": {"attribute": "Tag", "arguments": {"level": "2"}}}, "k % 5 = 1 AND k % 3 = 2")
_rule("c35_any_attributes_with_arguments", "type", {"haveAnyAttributesWithArguments": ["x"]}, "k % 5 = 2 OR k % 10 = 1")
_rule("c36_any_attributes_with_named", "type", {"doNotHaveAnyAttributesWithNamedArguments": {"level": "0"}}, "NOT coalesce(k % 5 = 1 AND k % 3 = 0, false)")
_rule("c37_assignable_to", "type", {"beAssignableTo": ["Shop.IB"]}, "ib")
_rule("c38_implement", "type", {"implementInterface": ["Shop.IA"]}, "ia")
_rule("c38_implement_selected", "type", {"implementInterface": {"kind": "interface", "where": {"haveNameEndingWith": "B"}}}, "ib")
_rule("c39_implement_any", "type", {"implementAnyInterfaces": ["Shop.IB"]}, "ib")
_rule("c40_enums", "type", {"beEnums": True}, "kind = 'enum'")
_rule("c41_structs", "type", {"notBeStructs": True}, "kind != 'struct'")
_rule("c42_value_types", "type", {"beValueTypes": True}, "kind IN ('enum', 'struct')")
_rule("c43_nested", "type", {"beNested": True}, "nested")
_rule("c44_nested_in", "type", {"beNestedIn": _OPEN}, "EXISTS (SELECT 1 FROM t0 o WHERE t.key = o.key || '+Inner' AND o.vis = 'public')")
_rule("c45_member_name", "type", {"haveMemberWithName": "make"}, "NOT nested")
_rule("c46_field_name", "type", {"haveFieldMemberWithName": ["SIZE", "Price"]}, "NOT nested")
_rule("c46_field_name_none", "type", {"haveFieldMemberWithName": ["Price"]}, "false")
_rule("c47_method_name", "type", {"haveMethodMemberWithName": ".CTOR"}, "NOT nested")
_rule("c48_property_name", "type", {"doNotHavePropertyMemberWithName": "price"}, "nested")
_rule("c49_abstract", "type", {"beAbstract": True}, "abstract")
_rule("c49_abstract_members", "method", {"beAbstract": True}, "abstract")
_rule("c50_sealed", "type", {"notBeSealed": True}, "NOT sealed")
_rule("c51_record", "type", {"beRecord": True}, "record")
_rule("c52_immutable_types", "type", {"beImmutable": True}, "immutable")
_rule("c53_generic", "type", {"beGeneric": True}, "generic")
_rule("c54_declared_in", "member", {"beDeclaredIn": _IFACE}, "owner_kind = 'interface'")
_rule("c55_static", "type", {"beStatic": True}, "static")
_rule("c55_static_members", "member", {"notBeStatic": True}, "NOT static")
_rule("c56_read_only_members", "member", {"beReadOnly": True}, "CASE kind WHEN 'field' THEN ro WHEN 'property' THEN setter IS NULL AND init IS NULL ELSE false END", sql_where="kind IN ('field', 'property')", where={"any": [{"haveName": "Size"}, {"haveName": "Price"}]})
_rule("c57_constructor", "member", {"beConstructor": True}, "kind = 'constructor'")
_rule("c58_virtual", "member", {"beVirtual": True}, "virt")
_rule("c59_return_type", "method", {"haveReturnType": ["Shop.IB"]}, "kind = 'method' AND k % 2 = 1")
_rule("c60_body_dependency", "method", {"haveDependencyInMethodBodyTo": _IFACE}, "kind = 'method' AND k % 2 = 0 AND EXISTS (SELECT 1 FROM td WHERE td.source = mb.owner AND tkind = 'interface')")
_rule("c61_called_by_class", "member", {"beCalledBy": {"kind": "class"}}, "name = 'Price' AND EXISTS (SELECT 1 FROM td WHERE td.target = mb.owner AND td.skind = 'class')")
_rule("c62_getter", "property", {"haveGetter": True}, "getter IS NOT NULL")
_rule("c63_setter", "property", {"haveSetter": True}, "setter IS NOT NULL OR init IS NOT NULL")
_rule("c64_init_setter", "property", {"haveInitOnlySetter": True}, "init IS NOT NULL")
_rule("c77_diagram_types", "type", {"adhereToPlantUmlDiagram": "[One] <<Shop\\.Brand1.*>>\n[Two] <<Shop\\.Brand2.*>>\n[Two] --> [One]"}, "NOT EXISTS (SELECT 1 FROM td JOIN t b ON b.key = td.target WHERE td.source = t.key AND starts_with(t.ns, 'Shop.Brand1') AND starts_with(b.ns, 'Shop.Brand2'))", {"resideInNamespaceMatching": "Brand[12]"}, "regexp_matches(ns, 'Brand[12]')")
_rule("e02_structs_by_selector", "interface", {"bePublic": True}, "vis = 'public'")


@q(f"WITH {RICH_SQL} SELECT key, generic AS passed FROM t0 WHERE k % 3 = 0", "e03_selector_language")
def e03_selector_language(spark: SparkSession, d: str) -> DataFrame:
    """A rule over the types of one of two languages, which alone can answer it."""
    c = rich_layer(spark, d)
    n = F.nullif(F.regexp_extract("fullName", "Part([0-9]+)$", 1), F.lit("")).cast("int")
    c = Code(c.types.withColumn("language", F.when(n % 3 == 0, "dotnet").otherwise("python")), c.members, c.dependencies, c.attributes, c.calls)
    return elements.evaluate(c, {"select": {"kind": "type", "language": "dotnet"}, "should": {"beGeneric": True}})[0]


_rule("e03_selector_referenced", "interface", {"haveNameStartingWith": "I"}, "false", sql_where="true", view="(SELECT key, kind FROM t)", where={"haveNameStartingWith": "Part"}, more={"includeReferenced": True})
_rule("e04_nested_selector", "type", {"dependOnAny": {"kind": "type", "where": {"areSealed": True, "dependOnAny": _IFACE}}}, "EXISTS (SELECT 1 FROM td a JOIN t0 m ON m.key = a.target AND m.sealed JOIN td c ON c.source = a.target AND c.tkind = 'interface' WHERE a.source = t.key)")
_rule("e05_expression", "type", {"any": [{"all": [{"beAbstract": True}, {"not": {"bePublic": True}}]}, {"beSealed": True, "notBeNested": True}]}, "abstract AND vis != 'public' OR sealed AND NOT nested")
_rule("e06_existence", "type", {"exist": True}, "true", {"areAbstract": True, "areSealed": True}, "abstract AND sealed")
_rule("e09_grammar", "type", {"notBeSealed": True, "doNotHaveName": "inner"}, "NOT sealed AND name != 'Inner'", {"areNotAbstract": True}, "NOT abstract")
_rule("e11_own_dependencies", "method", {"dependOnAny": _IFACE}, "false")
_rule("e12_assignable_set", "type", {"beAssignableTo": {"kind": "interface", "where": {"haveFullNameMatching": "^Shop\\.I[AB]$"}}}, "ia OR ib")
_rule("z03_folded_names", "type", {"haveFullNameContaining": "BRAND2", "haveNameStartingWith": "P"}, "contains(lower(key), 'brand2') AND starts_with(name, 'P')")
_rule("z04_generic_definition", "method", {"doNotHaveReturnType": ["Shop.IB"]}, "NOT (kind = 'method' AND k % 2 = 1)")


@q(f"WITH {RICH_SQL} SELECT 'element' AS type, 'shut' AS rule, 'warn' AS severity, 'shop/Part' || regexp_extract(key, 'Part([0-9]+)', 1) || '.cs' AS \"from\", key AS \"to\", 'RB-' || substr(sha256('shut' || chr(10) || 'shop/Part' || regexp_extract(key, 'Part([0-9]+)', 1) || '.cs' || chr(10) || key || chr(10)), 1, 8) AS id FROM t WHERE NOT (vis = 'public')", "e08_findings")
def e08_findings(spark: SparkSession, d: str) -> DataFrame:
    return elements.findings(rich_layer(spark, d), {"select": {"kind": "type"}, "should": {"bePublic": True}}, "shut")


@q(f"WITH {RICH_SQL} SELECT x.ns AS \"from\", y.ns AS \"to\", count(DISTINCT x.key || ' -> ' || y.key) AS edges FROM td JOIN t0 x ON x.key = td.source JOIN t0 y ON y.key = td.target WHERE x.ns != y.ns GROUP BY ALL", "l04_members_of_types")
def l04_members_of_types(spark: SparkSession, d: str) -> DataFrame:
    """Slices of types by namespace: the unit of that language is the type."""
    c = rich_layer(spark, d)
    e = sl.type_slice_edges(c.types, c.dependencies, sl.parse("Shop.(*)"))
    return e.select(F.concat(F.lit("Shop."), "from").alias("from"), F.concat(F.lit("Shop."), "to").alias("to"), F.size("members").cast("bigint").alias("edges"))


def code_sql(rest: str) -> str:
    from depweave.sources.views import CODE_SQL

    return f"WITH {CODE_SQL} {rest}"


@q(code_sql("SELECT source, CASE WHEN regexp_matches(source, '/libs/') AND regexp_matches(source, '\\.ts$') AND regexp_extract(source, '/libs/+([^/]+/[^/]+)', 1) NOT IN ('', 'ui/core') THEN regexp_extract(source, '/libs/+([^/]+/[^/]+)', 1) END AS slice FROM m WHERE NOT core AND NOT unresolved AND regexp_matches(source, '/libs/[^/]+/[^/]+')"), "l03_segments_ignore_where")
def l03_segments_ignore_where(spark: SparkSession, d: str) -> DataFrame:
    """Two segments, one slice ignored, modules of one ending only."""
    m = code_graph(spark, d).modules.where("not coreModule and not couldNotResolve and source rlike '/libs/[^/]+/[^/]+'")
    return m.select("source", sl.slice_name(F.col("source"), sl.parse("/libs/(*)", segments=2, ignore=["ui/core"], where="\\.ts$")).alias("slice"))


@q(code_sql("SELECT source, CASE WHEN regexp_matches(source, '/libs/') THEN 'libs/' || regexp_extract(source, '/libs/+([^/]+)', 1) END AS slice FROM m WHERE regexp_matches(source, '^[0-9]+/')"), "l10_diagram_slices")
def l10_diagram_slices(spark: SparkSession, d: str) -> DataFrame:
    """Slices as a diagram names them: with the prefix they lie below."""
    m = code_graph(spark, d).modules.where("source rlike '^[0-9]+/'")
    return m.select("source", sl.diagram_name(F.col("source"), sl.parse("/libs/(*)", segments=1)).alias("slice"))


@q(code_sql("SELECT 'slice' AS type, 'apart' AS rule, 'warn' AS severity, f AS \"from\", t AS \"to\" FROM (SELECT DISTINCT regexp_extract(e.source, '/libs/([^/]+)', 1) AS f, regexp_extract(e.resolved, '/libs/([^/]+)', 1) AS t FROM e WHERE NOT coreModule AND NOT couldNotResolve AND regexp_matches(e.source, '/libs/') AND regexp_matches(e.resolved, '/libs/')) WHERE f != t"), "l08_slice_findings")
def l08_slice_findings(spark: SparkSession, d: str) -> DataFrame:
    e = sl.slice_edges(code_graph(spark, d), sl.parse("/libs/(*)", segments=1))
    none = e.limit(0).select(F.array("from").alias("slices"))
    return sl.findings(e, none, "apart", "warn")


_LINKS = f"WITH {RICH_SQL}, l AS (SELECT DISTINCT source AS a, target AS b FROM td UNION SELECT key, ns FROM t UNION SELECT ns, key FROM t)"
for _ignore, _cond in ((None, "true"), ("parents", "NOT starts_with(a, b)"), ("children", "NOT starts_with(b, a)"), ("both", "NOT starts_with(a, b) AND NOT starts_with(b, a)")):

    @q(f'{_LINKS} SELECT a AS "from", b AS "to" FROM l WHERE {_cond}', f"x06_export_{_ignore or 'all'}")
    def _export(spark: SparkSession, d: str, ignore: str | None = _ignore) -> DataFrame:
        c = rich_layer(spark, d)
        t = c.types.where("not coalesce(referenced, false)").select("fullName", F.col("namespaces")[0].alias("ns"))
        links = c.dependencies.select(F.col("source").alias("from"), F.col("target").alias("to")).unionByName(t.select(F.col("fullName").alias("from"), F.col("ns").alias("to"))).unionByName(t.select(F.col("ns").alias("from"), F.col("fullName").alias("to")))
        return diagrams.export_edges(links, ignore)


@q(f"WITH {RICH_SQL} SELECT '[' || a || '] --|> [' || b || ']' AS line FROM (SELECT DISTINCT x.ns AS a, y.ns AS b FROM td JOIN t0 x ON x.key = td.source JOIN t0 y ON y.key = td.target WHERE x.ns != y.ns)", "x07_namespace_diagram")
def x07_namespace_diagram(spark: SparkSession, d: str) -> DataFrame:
    """The arrows of a diagram of namespaces, as the exported text has them."""
    c = rich_layer(spark, d)
    e = sl.type_slice_edges(c.types, c.dependencies, sl.parse("Shop.(*)"))
    pairs = [(r[0], r[1]) for r in e.select(F.concat(F.lit("Shop."), "from"), F.concat(F.lit("Shop."), "to")).collect()]  # as many as pairs of namespaces
    lines = [x for x in diagrams.plantuml(pairs).splitlines() if "--|>" in x]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@q("SELECT kind, concept, applies FROM (VALUES ('field', 'readOnly', true), ('field', 'assignableTo', false), ('method', 'haveReturnType', true), ('class', 'haveReturnType', false), ('interface', 'sealed', false), ('class', 'sealed', true), ('function', 'nested', false), ('module', 'public', false), ('module', 'haveName', true), ('property', 'constructor', false)) v(kind, concept, applies)", "e15_applicability")
def e15_applicability(spark: SparkSession, d: str) -> DataFrame:
    """Whether a kind can answer a concept."""
    asked = [("field", "readOnly"), ("field", "assignableTo"), ("method", "haveReturnType"), ("class", "haveReturnType"), ("interface", "sealed"), ("class", "sealed"), ("function", "nested"), ("module", "public"), ("module", "haveName"), ("property", "constructor")]
    return spark.createDataFrame([(k, c, c not in elements.KINDS_OF or k in elements.KINDS_OF[c]) for k, c in asked], "kind string, concept string, applies boolean")


@q("SELECT language, concept, answered FROM (VALUES ('python', 'beSealed', false), ('python', 'bePublic', true), ('typescript', 'beVirtual', false), ('typescript', 'beAbstract', true), ('dotnet', 'beRecord', true), ('python', 'haveNameContaining', true)) v(language, concept, answered)", "e14_languages")
def e14_languages(spark: SparkSession, d: str) -> DataFrame:
    """Whether a rule over types of a language is taken or refused."""
    asked = [("python", "beSealed"), ("python", "bePublic"), ("typescript", "beVirtual"), ("typescript", "beAbstract"), ("dotnet", "beRecord"), ("python", "haveNameContaining")]

    def taken(language: str, key: str) -> bool:
        c = Code.of(spark.createDataFrame([("a.B", "B", "class", language)], "fullName string, name string, kind string, language string"), spark.createDataFrame([("a.B::m", "m", "method", "a.B", language)], "fullName string, name string, kind string, declaringType string, language string"))
        try:
            elements.evaluate(c, {"select": {"kind": "method" if key == "beVirtual" else "type"}, "should": {key: "x" if "Name" in key else True}})
        except elements.ElementError:
            return False
        return True

    return spark.createDataFrame([(a, b, taken(a, b)) for a, b in asked], "language string, concept string, answered boolean")
