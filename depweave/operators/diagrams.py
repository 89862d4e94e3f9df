"""Component diagrams: reading them, and holding dependencies against them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions import regex


@dataclass(frozen=True)
class Diagram:
    """Components with their stereotypes (namespace patterns) and the arrows between components."""

    stereotypes: tuple[tuple[str, str], ...]  # (component, pattern)
    arrows: tuple[tuple[str, str], ...]


def parse(text: str) -> Diagram:
    """``[Name] <<pattern>> as alias`` and arrows between names or aliases; stereotypes must be unique."""
    names: dict[str, str] = {}
    stereotypes: list[tuple[str, str]] = []
    arrows: list[tuple[str, str]] = []
    end = r"(?:\[([^\]]+)\]|(\w+))"
    for raw in text.splitlines():
        line = raw.split("'")[0].strip()
        m = re.match(r"(?:component\s+)?\[([^\]]+)\]((?:\s*<<[^>]+>>)+)\s*(?:as\s+(\w+))?", line)
        if m:
            names[m.group(1)] = m.group(1)
            if m.group(3):
                names[m.group(3)] = m.group(1)
            stereotypes += [(m.group(1), p.strip()) for p in re.findall(r"<<([^>]+)>>", m.group(2))]
            continue
        m = re.match(rf"{end}\s*(<?)[-.]+(?:\w+[-.]+)?(>?)\s*{end}", line)
        if m:
            a, b = m.group(1) or m.group(2), m.group(5) or m.group(6)
            if a in names and b in names:
                a, b = names[a], names[b]
                arrows.append((b, a) if m.group(3) and not m.group(4) else (a, b))
            else:
                raise ValueError(f"unknown component in {raw.strip()!r}")
    patterns = [p for _, p in stereotypes]
    if len(set(patterns)) != len(patterns):
        raise ValueError("stereotypes must be unique")
    if not stereotypes:
        raise ValueError("the diagram has no components")
    return Diagram(tuple(stereotypes), tuple(arrows))


def components_of(namespaces: DataFrame, d: Diagram) -> DataFrame:
    """(namespace, components): the components whose stereotype matches (X2). One pass, patterns are constants of the plan."""
    hits = F.array_compact(F.array(*[F.when(regex.matches(F.col("namespace"), f"^(?:{p})$"), F.lit(c)) for c, p in d.stereotypes]))
    return namespaces.select("namespace", F.array_distinct(hits).alias("components"))


def adherence(types: DataFrame, dependencies: DataFrame, d: Diagram) -> DataFrame:
    """(type, passed): whether a type's dependencies inside the diagram follow its arrows.

    ``types`` is (type, namespace). Dependencies on types outside the diagram
    do not count; a type in more than one component is an error. Own
    components are always allowed.
    """
    ns = components_of(types.select("namespace").distinct(), d)
    t = types.join(ns, "namespace").where(F.size("components") > 0)
    one = F.when(F.size("components") > 1, F.raise_error(F.concat(F.lit("more than one component for "), F.col("type"))).cast("string")).otherwise(F.get("components", F.lit(0)))
    t = t.select("type", one.alias("component"))
    spark: SparkSession = types.sparkSession
    allowed = spark.createDataFrame([*d.arrows, *[(c, c) for c in {c for c, _ in d.stereotypes}]], "a string, b string").distinct()
    e = dependencies.join(t.select(F.col("type").alias("source"), F.col("component").alias("a")), "source").join(t.select(F.col("type").alias("target"), F.col("component").alias("b")), "target")
    bad = e.join(allowed, ["a", "b"], "left_anti").select(F.col("source").alias("type")).distinct().withColumn("bad_", F.lit(True))
    return t.select("type").join(bad, "type", "left").select("type", F.col("bad_").isNull().alias("passed"))


def export_edges(edges: DataFrame, ignore: str | None = None) -> DataFrame:
    """Edges for a diagram (from, to), without those to parents, to children, or both (X6); names without a point are kept."""
    dotted = F.col("from").contains(".") | F.col("to").contains(".")
    parent, child = F.col("from").startswith(F.col("to")), F.col("to").startswith(F.col("from"))
    drop = {"parents": parent, "children": child, "both": parent | child, None: F.lit(False)}[ignore]
    return edges.where(~(dotted & drop)).select("from", "to").distinct()


def plantuml(edges: Sequence[tuple[str, str]], lone: Sequence[str] = ()) -> str:
    """Component diagram text of a small edge list."""
    names = sorted({n for e in edges for n in e} | set(lone))
    return "\n".join(["@startuml", *[f"[{n}]" for n in names], *[f"[{a}] --|> [{b}]" for a, b in sorted(edges)], "@enduml", ""])
