"""Element rules on a small code layer written by hand."""

import pytest

from depweave.operators import diagrams, elements
from depweave.operators.elements import Code, ElementError, concept_of

T = "fullName string, name string, namespaces array<string>, kind string, visibility string, assembly string, files array<string>, abstract boolean, sealed boolean, nested boolean, baseType string, interfaces array<string>, referenced boolean"
M = "fullName string, name string, kind string, visibility string, declaringType string, static boolean, readOnly boolean, virtual boolean, returnType string, getter string, setter string, initSetter string"


@pytest.fixture(scope="module")
def code(spark):
    t = spark.createDataFrame(
        [
            ("N.A", "A", ["N"], "class", "public", "Asm, Version=1", ["a.cs"], True, None, None, "N.B", ["N.I"], None),
            ("N.B", "B", ["N"], "class", "internal", "Asm, Version=1", ["b.cs"], False, True, False, None, [], None),
            ("N.I", "I", ["N"], "interface", "public", "Asm, Version=1", ["i.cs"], None, None, None, None, None, None),
            ("N.B+C", "C", ["N"], "struct", "private", "Asm, Version=1", ["b.cs"], None, None, True, None, None, None),
            ("X.R", "R", ["X"], "class", "public", None, None, None, None, None, None, None, True),
        ], T,
    )
    m = spark.createDataFrame(
        [
            ("N.A::m", "m", "method", "public", "N.A", False, None, True, "Task<int>", None, None, None),
            ("N.A::ctor", "ctor", "constructor", "private", "N.A", False, None, None, None, None, None, None),
            ("N.B::f", "f", "field", "private", "N.B", False, True, None, None, None, None, None),
            ("N.B+C::p", "p", "property", "public", "N.B+C", False, None, None, None, "public", "private", None),
            ("N.A::q", "q", "property", "public", "N.A", False, None, None, None, "public", None, "internal"),
        ], M,
    )
    d = spark.createDataFrame([("N.A", "N.B", "body", "body-type", "N.A::m"), ("N.A", "X.R", "field", None, None), ("N.B", "N.A", "field", None, None)], "source string, target string, kind string, form string, member string")
    a = spark.createDataFrame([("N.A", "Tag", ["1", "2"], [("k", "v")]), ("N.A", "Tag", ["3"], None), ("N.B", "Other", ["1"], None)], "target string, attributeType string, arguments array<string>, namedArguments array<struct<name:string,value:string>>")
    c = spark.createDataFrame([("N.A::m", "N.B::f")], "`from` string, `to` string")
    tt = t.unionByName(spark.createDataFrame([("Tag", "Tag", [""], "attribute", "public", None, None, None, None, None, None, None, True), ("Other", "Other", [""], "attribute", "public", None, None, None, None, None, None, None, True), ("Task", "Task", [""], "class", "public", None, None, None, None, None, None, None, True)], T))
    return Code.of(tt, m, d, a, c)


def passed(code, kind, should, where=None):
    sel = {"kind": kind, **({"where": where} if where else {})}
    return sorted(r["key"] for r in elements.evaluate(code, {"select": sel, "should": should})[0].where("passed").collect())


CASES = [
    ("type", {"bePublic": True}, ["N.A", "N.I"]), ("type", {"notBePublic": True}, ["N.B", "N.B+C"]), ("type", {"beAbstract": True}, ["N.A"]), ("type", {"notBeSealed": True}, ["N.A", "N.B+C", "N.I"]),
    ("class", {"haveName": "a"}, ["N.A"]), ("class", {"haveNameStartingWith": "a"}, []), ("class", {"haveFullNameContaining": "n.a"}, ["N.A"]), ("type", {"resideInAssembly": "asm"}, ["N.A", "N.B", "N.B+C", "N.I"]),
    ("type", {"dependOnAny": ["N.B"]}, ["N.A"]), ("type", {"onlyDependOn": ["N.A"]}, ["N.B", "N.B+C", "N.I"]), ("type", {"callAny": ["N.B::f"]}, ["N.A"]), ("field", {"beCalledBy": ["N.A"]}, ["N.B::f"]),
    ("type", {"haveAnyAttributes": ["Tag"]}, ["N.A"]), ("type", {"onlyHaveAttributes": ["Other"]}, ["N.B", "N.B+C", "N.I"]),
    ("type", {"haveAttributeWithArguments": {"attribute": "Tag", "arguments": ["1", "2"]}}, ["N.A"]), ("type", {"haveAttributeWithArguments": {"attribute": "Tag", "arguments": ["1", "3"]}}, []),
    ("type", {"doNotHaveAttributeWithArguments": {"attribute": "Tag", "arguments": ["1", "9"]}}, ["N.B", "N.B+C", "N.I"]), ("type", {"haveAnyAttributesWithNamedArguments": {"k": "v"}}, ["N.A"]),
    ("type", {"beAssignableTo": ["N.B"]}, ["N.A", "N.B"]), ("type", {"implementInterface": ["N.I", "Unknown"]}, ["N.A"]), ("type", {"implementAnyInterfaces": {"kind": "interface"}}, ["N.A"]),
    ("type", {"beNestedIn": ["N.B"]}, ["N.B+C"]), ("type", {"beNested": False}, ["N.A", "N.B", "N.I"]), ("type", {"haveMethodMemberWithName": "M"}, ["N.A"]), ("type", {"beImmutable": True}, ["N.A", "N.B", "N.I"]),
    ("method", {"beConstructor": True}, ["N.A::ctor"]), ("method", {"beVirtual": True}, ["N.A::m"]), ("method", {"haveReturnType": ["Task"]}, ["N.A::m"]), ("method", {"haveDependencyInMethodBodyTo": ["N.B"]}, ["N.A::m"]),
    ("property", {"haveSetter": True}, ["N.A::q", "N.B+C::p"]), ("property", {"haveInitOnlySetter": True}, ["N.A::q"]), ("property", {"haveInternalSetter": True}, ["N.A::q"]), ("property", {"havePublicGetter": True}, ["N.A::q", "N.B+C::p"]), ("member", {"beDeclaredIn": ["N.B"]}, ["N.B::f"]),
    ("type", {"any": [{"beStructs": True}, {"not": {"bePublic": True}}]}, ["N.B", "N.B+C"]), ("type", {"exist": True}, ["N.A", "N.B", "N.B+C", "N.I"]), ("type", {"notExist": True}, []), ("type", {"be": ["N.I"]}, ["N.I"]), ("type", {"areNot": {"kind": "interface"}}, ["N.A", "N.B", "N.B+C"]),
]


@pytest.mark.parametrize(("kind", "should", "want"), CASES)
def test_conditions(code, kind, should, want):
    assert passed(code, kind, should) == want


def test_selection_and_errors(code, rows):
    assert passed(code, "type", {"bePublic": True}, {"resideInNamespaceMatching": "^N$", "areNotAbstract": True}) == ["N.I"]
    out, empty = elements.evaluate(code, {"select": {"kind": "function"}, "should": {"bePublic": True}})
    assert empty and out.count() == 0
    for bad in ({"beFast": True}, {"dependOnAny": ["No.Such"]}, {"beRecord": True, "haveReturnTypes": 1}):
        with pytest.raises(ElementError):
            passed(code, "type", bad)
    with pytest.raises(ElementError):
        passed(code, "module-thing", {"bePublic": True})
    f = elements.findings(code, {"select": {"kind": "type"}, "should": {"bePublic": True}}, "r", "error")
    assert rows(f, "from", "to") == [("b.cs", "N.B"), ("b.cs", "N.B+C")]
    assert concept_of("doNotHaveName") == ("haveName", True) and concept_of("dependOnAny") == ("dependOnAny", False) and concept_of("notDependOnAny") == ("dependOnAny", True) and concept_of("areAssignableToThat") == ("assignableTo", False)


def test_diagrams(spark, rows):
    d = diagrams.parse("@startuml\n[Web] <<.*\\.Web>> as w\n[Core] <<.*\\.Core>>\nw --> [Core]\n' a comment\n@enduml")
    t = spark.createDataFrame([("W1", "N.Web"), ("C1", "N.Core"), ("C2", "N.Core"), ("O", "N.Other")], "type string, namespace string")
    e = spark.createDataFrame([("W1", "C1"), ("C1", "W1"), ("C2", "O"), ("C2", "C1")], "source string, target string")
    assert rows(diagrams.adherence(t, e, d)) == [("C1", False), ("C2", True), ("W1", True)]
    for bad in ("[A] <<x>>\n[B] <<x>>", "[A] <<x>>\n[A] --> [Z]", "nothing"):
        with pytest.raises(ValueError):
            diagrams.parse(bad)
    x = spark.createDataFrame([("a.b", "a"), ("a", "a.b"), ("q", "qq")], "`from` string, `to` string")
    assert rows(diagrams.export_edges(x, "parents")) == [("a", "a.b"), ("q", "qq")] and diagrams.export_edges(x).count() == 3
    assert diagrams.plantuml([("a", "b")]) == "@startuml\n[a]\n[b]\n[a] --|> [b]\n@enduml\n"


def test_conditions_that_do_not_apply(code):
    for kind, should in (("field", {"beVirtual": True}), ("type", {"haveGetter": True}), ("interface", {"beSealed": True}), ("method", {"beNested": True}), ("class", {"beDeclaredIn": ["N.A"]})):
        with pytest.raises(ElementError):
            passed(code, kind, should)


def test_modules_as_elements(spark, code):
    from depweave.operators.graph import Graph

    g = Graph.of(spark.createDataFrame([("a/x.ts", 0, "b/y.ts", False), ("b/y.ts", 0, "fs", True)], "source string, ord long, resolved string, coreModule boolean"))
    c = Code.of(code.types, code.members, code.dependencies, code.attributes, code.calls, g)
    assert passed(c, "module", {"dependOnAny": ["b/y.ts"]}) == ["a/x.ts"] and passed(c, "module", {"haveNameEndingWith": ".ts"}) == ["a/x.ts", "b/y.ts"]
    assert passed(c, "module", {"onlyDependOn": ["a/x.ts"]}) == ["b/y.ts"]
    with pytest.raises(ElementError):
        passed(c, "module", {"bePublic": True})


def test_diagram_condition(code):
    assert passed(code, "type", {"adhereToPlantUmlDiagram": "[Q] <<X>>\n[R] <<N>>\n[Q] --> [R]"}) == ["N.B", "N.B+C", "N.I"]
