"""Graphs and code layers over the project's tables, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions.paths import path_form, path_form_sql
from depweave.operators.elements import Code
from depweave.operators.graph import Graph
from depweave.session import materialize
from depweave.sources.graphs import language


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def code_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every edge once, under the name of its run; core and unresolved targets keep their names."""
    e = table(spark, d, "edges").dropDuplicates(["run_id", "source", "ord"])
    under = lambda c: F.concat_ws("/", F.col("run_id").cast("string"), path_form(F.col(c)))
    outside = F.col("coreModule") | F.col("couldNotResolve")
    return e.withColumn("resolved", F.when(outside, path_form(F.col("resolved"))).otherwise(under("resolved"))).withColumn("source", under("source")).withColumn("ord", F.col("ord").cast("bigint"))


def code_graph(spark: SparkSession, d: str, saved: bool = True, asked: list[str] | None = None) -> Graph:
    """The graph of all runs. A module's language comes from its ending, its project is its first two folders.

    Deduplicated edges are written once, since most questions read the graph
    several times; ``saved`` off leaves everything lazy, for a single scan.
    With ``asked``, only these columns of the edges and what makes the modules
    are written, and modules stay lazy: for questions that read few of either.
    """
    write = materialize if saved else lambda df, label: df
    e = code_edges(spark, d).drop("instability", "circular", "valid", "ingested_at", "extracted_at", "repo", "run_id")
    if asked is not None:
        e = e.select("source", "ord", "resolved", "coreModule", "couldNotResolve", "matchesDoNotFollow", *asked)
    g = Graph.of(write(e, "code-edges"))
    if asked is not None:
        write = lambda df, label: df
    local = F.col("source").rlike("^[0-9]+/")
    project = F.when(local, F.nullif(F.regexp_extract("source", "^[0-9]+/[^/]+/[^/]+", 0), F.lit("")))
    return g.with_(modules=write(g.modules.withColumn("language", language(F.col("source"))).withColumn("project", project), "code-modules"))


_OUT = "CASE WHEN coreModule OR couldNotResolve THEN {p} ELSE run_id || '/' || {p} END".format(p=path_form_sql("resolved"))
CODE_SQL = f"""e AS (SELECT run_id || '/' || {path_form_sql("source")} AS source, CAST(ord AS BIGINT) AS ord, {_OUT} AS resolved, module, dependencyTypes, dependencyKind, moduleSystem, coreModule, couldNotResolve, dynamic, followable, typeOnly,
  coalesce(matchesDoNotFollow, false) AS dnf, line, extracted_at FROM (SELECT *, row_number() OVER (PARTITION BY run_id, source, ord ORDER BY ingested_at) AS k FROM edges) WHERE k = 1),
 p AS (SELECT DISTINCT source AS src, resolved AS dst FROM e),
 m AS (SELECT source, bool_or(c) AS core, bool_or(u) AS unresolved, bool_or(f) AS dnf, NOT (bool_or(c) OR bool_or(u) OR bool_or(f)) AS calculable, {{language}} AS language, nullif(regexp_extract(source, '^[0-9]+/[^/]+/[^/]+'), '') AS project
  FROM (SELECT source, false AS c, false AS u, false AS f FROM e UNION ALL SELECT resolved, coreModule, couldNotResolve, dnf FROM e) GROUP BY source)""".replace(
    "{language}",
    "CASE WHEN regexp_matches(lower(source), '\\.(ts|tsx|mts|cts)$') THEN 'typescript' WHEN regexp_matches(lower(source), '\\.(js|jsx|mjs|cjs|vue|svelte)$') THEN 'javascript' WHEN regexp_matches(lower(source), '\\.(cs|vb|fs)$') THEN 'dotnet' WHEN regexp_matches(lower(source), '\\.(py|pyi)$') THEN 'python' END",
)


def fk_graph(spark: SparkSession, d: str) -> Graph:
    """Foreign keys as edges: orders to customers, customers to nations, nations to regions."""
    o = table(spark, d, "orders").select(F.concat(F.lit("orders/"), "o_orderkey").alias("source"), F.concat(F.lit("customer/"), "o_custkey").alias("resolved"))
    c = table(spark, d, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("source"), F.concat(F.lit("nation/"), "c_nationkey").alias("resolved"))
    n = table(spark, d, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("source"), F.concat(F.lit("region/"), "n_regionkey").alias("resolved"))
    e = o.unionByName(c).unionByName(n).withColumn("ord", F.lit(0).cast("bigint")).withColumn("dependencyTypes", F.array(F.lit("local"))).withColumn("dependencyKind", F.lit("import"))
    return Graph.of(e)


FK_SQL = """fk AS (SELECT 'orders/' || o_orderkey AS source, 'customer/' || o_custkey AS resolved FROM orders UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer
 UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation)"""


def code_layer(spark: SparkSession, d: str) -> Code:
    """Types from parts (namespace: brand), members from their size and price, dependencies and calls along part keys."""
    p = table(spark, d, "part").where("p_partkey is not null")
    ns = F.regexp_replace(F.concat(F.lit("Shop."), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), r"\.$", "")
    name = F.concat(F.lit("Part"), F.col("p_partkey"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("class", "interface", "struct", "enum")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    types = p.select(
        F.concat_ws(".", ns, name).alias("fullName"), name.alias("name"), F.array(ns).alias("namespaces"), kind.alias("kind"), F.when(F.col("p_size") % 3 == 0, "private").otherwise("public").alias("visibility"), F.lit("Shop, Version=1.0").alias("assembly"),
        F.lit("dotnet").alias("language"), F.array(F.concat(F.lit("shop/"), name, F.lit(".cs"))).alias("files"), (F.col("p_size") % 5 == 0).alias("sealed"), (F.col("p_size") % 7 == 0).alias("abstract"), "p_partkey", ns.alias("ns_"),
    )
    types = types.withColumn("baseType", F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("Base"), F.col("p_partkey") % 10)))
    m = types.select("fullName", "p_partkey", F.explode(F.array(F.lit("Size"), F.lit("Price"))).alias("name"))
    members = m.select(F.concat_ws("::", "fullName", "name").alias("fullName"), "name", F.when(F.col("name") == "Size", "field").otherwise("property").alias("kind"), F.lit("public").alias("visibility"), F.col("fullName").alias("declaringType"), F.lit("dotnet").alias("language"), (F.col("p_partkey") % 2 == 0).alias("readOnly"), F.when(F.col("name") == "Price", "public").alias("getter"), F.when((F.col("name") == "Price") & (F.col("p_partkey") % 3 == 0), "private").alias("setter"))
    a, b = types.select("fullName", "p_partkey"), types.select(F.col("fullName").alias("target"), (F.col("p_partkey") - 3).alias("p_partkey"))
    deps = a.join(b, "p_partkey").select(F.col("fullName").alias("source"), "target", F.lit("body").alias("kind"), F.lit("body-type").alias("form"))
    attrs = types.where("p_partkey % 5 = 1").select(F.col("fullName").alias("target"), F.lit("Tag").alias("attributeType"), F.array((F.col("p_partkey") % 4).cast("string")).alias("arguments"))
    calls = members.where("name = 'Price'").select(F.col("fullName").alias("from"), "declaringType").join(deps.withColumnRenamed("source", "declaringType"), "declaringType").select("from", F.concat(F.col("target"), F.lit("::Price")).alias("to"))
    return Code.of(types.drop("p_partkey", "ns_"), members, deps, attrs, calls)


LAYER_SQL = """t AS (SELECT 'Shop.' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS ns, 'Part' || p_partkey AS name, 'Shop.' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || '.Part' || p_partkey AS key, p_partkey AS k, p_size AS size,
  CASE p_partkey % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'struct' ELSE 'enum' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'private' ELSE 'public' END AS visibility FROM part),
 td AS (SELECT a.key AS source, b.key AS target, a.k FROM t a JOIN t b ON b.k = a.k + 3)"""
