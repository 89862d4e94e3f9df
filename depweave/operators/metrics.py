"""Coupling and instability of modules, folders and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.functions.paths import dirname, parents
from depweave.operators.graph import EDGE_COLUMNS, MODULE_COLUMNS, Graph, complete


def instability(ce: Column, ca: Column) -> Column:
    """Ce / (Ce + Ca), 0 where both are 0."""
    return F.when(ce + ca == 0, F.lit(0.0)).otherwise(ce.cast("double") / (ce + ca))


def calculable() -> Column:
    """Neither core, nor unresolved, nor beyond what is followed."""
    no = [F.coalesce(F.col(c), F.lit(False)) for c in ("coreModule", "couldNotResolve", "matchesDoNotFollow")]
    return ~(no[0] | no[1] | no[2])


def couplings(g: Graph) -> DataFrame:
    """(source, ce, ca, instability) of calculable modules: edges out, distinct importers in (trap 5)."""
    ce = g.edges.groupBy("source").agg(F.count(F.lit(1)).alias("ce"))
    ca = g.edges.select(F.col("resolved").alias("source"), F.col("source").alias("by")).distinct().groupBy("source").agg(F.count(F.lit(1)).alias("ca"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    m = g.modules.where(calculable()).select("source").join(ce, "source", "left").join(ca, "source", "left").select("source", zero("ce"), zero("ca"))
    return m.withColumn("instability", instability(F.col("ce"), F.col("ca")))


def with_metrics(g: Graph) -> Graph:
    """Instability on modules, and of the target on every edge, 0 where it has none."""
    i = couplings(g).select("source", "instability")
    modules = g.modules.drop("instability").join(i, "source", "left")
    edges = g.edges.drop("instability").join(i.withColumnRenamed("source", "resolved"), "resolved", "left").withColumn("instability", F.coalesce("instability", F.lit(0.0)))
    return Graph(complete(modules, MODULE_COLUMNS), complete(edges, EDGE_COLUMNS))


def folder_table(g: Graph) -> DataFrame:
    """(name, moduleCount, afferentCouplings, efferentCouplings, instability, size, statements) of every parent folder (A2, A3)."""
    m = g.modules.where(calculable()).select("source", "size", "statements", F.explode(parents(dirname(F.col("source")))).alias("name"))
    count = m.groupBy("name").agg(F.count(F.lit(1)).alias("moduleCount"), F.sum("size").alias("size"), F.sum("statements").alias("statements"))
    outside = lambda c: ~F.col(c).startswith(F.concat(F.col("name"), F.lit("/")))
    ce = m.select("source", "name").join(g.edges.select("source", "resolved"), "source").where(outside("resolved")).groupBy("name").agg(F.count(F.lit(1)).alias("ce"))
    by = g.edges.select(F.col("resolved").alias("source"), F.col("source").alias("by")).distinct()
    ca = m.select("source", "name").join(by, "source").where(outside("by")).groupBy("name").agg(F.count(F.lit(1)).alias("ca"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    t = count.join(ce, "name", "left").join(ca, "name", "left")
    return t.select("name", "moduleCount", zero("ca").alias("afferentCouplings"), zero("ce").alias("efferentCouplings"), instability(zero("ce"), zero("ca")).alias("instability"), "size", "statements")


def folder_edges(g: Graph, folders: DataFrame) -> DataFrame:
    """(name, to, from_instability, instability): a folder and the distinct folders its modules' edges lead out to (A3, A4)."""
    m = g.modules.where(calculable()).select("source", F.explode(parents(dirname(F.col("source")))).alias("name"))
    e = m.join(g.edges.select("source", "resolved"), "source").where(~F.col("resolved").startswith(F.concat(F.col("name"), F.lit("/"))))
    d = dirname(F.col("resolved"))
    pairs = e.select("name", F.when(d == ".", F.col("resolved")).otherwise(d).alias("to")).distinct()
    i = folders.select("name", "instability")
    return pairs.join(i.withColumnRenamed("instability", "from_instability"), "name", "left").join(i.select(F.col("name").alias("to"), "instability"), "to", "left").select("name", "to", "from_instability", F.coalesce("instability", F.lit(0.0)).alias("instability"))


def sinks(folders: DataFrame, edges: DataFrame) -> DataFrame:
    """Coupled folders that hold no calculable module, with moduleCount -1 (A5)."""
    out = edges.select(F.col("to").alias("name")).distinct().join(folders.select("name"), "name", "left_anti")
    return out.withColumn("moduleCount", F.lit(-1).cast("bigint"))


def project_table(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Project records and project edges (A7, A8); both empty where no module has a project.

    A coupling leads to the owning project of its target, or to the target's
    own name where it has none. Couplings inside a project do not count.
    """
    own = g.modules.where(F.col("project").isNotNull()).select("source", "project")
    m = g.modules.where(calculable() & F.col("project").isNotNull())
    count = m.groupBy(F.col("project").alias("name")).agg(F.count(F.lit(1)).alias("moduleCount"), F.sum("size").alias("size"), F.sum("statements").alias("statements"))
    mine = m.select("source", F.col("project").alias("name"))
    out = mine.join(g.edges.select("source", "resolved"), "source").join(own.select(F.col("source").alias("resolved"), F.col("project").alias("p")), "resolved", "left").select("name", F.coalesce("p", "resolved").alias("to")).where("name != to")
    by = g.edges.select(F.col("resolved").alias("source"), F.col("source").alias("by")).distinct()
    into = mine.join(by, "source").join(own.select(F.col("source").alias("by"), F.col("project").alias("p")), "by", "left").select("name", F.coalesce("p", "by").alias("from")).where("name != from")
    t = count.join(out.groupBy("name").agg(F.count(F.lit(1)).alias("ce")), "name", "left").join(into.groupBy("name").agg(F.count(F.lit(1)).alias("ca")), "name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    t = t.select("name", "moduleCount", zero("ca").alias("afferentCouplings"), zero("ce").alias("efferentCouplings"), instability(zero("ce"), zero("ca")).alias("instability"), "size", "statements")
    i = t.select("name", "instability")
    e = out.distinct().join(i.withColumnRenamed("instability", "from_instability"), "name", "left").join(i.select(F.col("name").alias("to"), "instability"), "to", "left")
    return t, e.select("name", "to", "from_instability", F.coalesce("instability", F.lit(0.0)).alias("instability"))


def receipts(g: Graph) -> DataFrame:
    """Modules per language."""
    return g.modules.groupBy("language").agg(F.count(F.lit(1)).alias("modules"))


def totals(g: Graph) -> DataFrame:
    """One row: modules and edges."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    both = g.modules.select(one.alias("m"), none.alias("e")).unionByName(g.edges.select(none.alias("m"), one.alias("e")))
    return both.agg(F.coalesce(F.sum("m"), none).alias("totalCruised"), F.coalesce(F.sum("e"), none).alias("totalDependenciesCruised"))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the size metric of a file."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")
