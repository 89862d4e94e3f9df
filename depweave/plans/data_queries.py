"""Queries p1, p2, p4 and p5: the general data problems over the project's own tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions.paths import name_set, path_form, path_form_sql, path_set
from depweave.operators.reconcile import Field, reconcile
from depweave.operators.shred import graph_tables, shred
from depweave.operators.skew import distinct_counts, skew_join
from depweave.operators.snapshots import snapshot_changes
from depweave.session import materialize


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _type_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").select(path_form(F.col("resolved")).alias("resolved"), "run_id", "source", "ord", "dependencyTypes")
    return materialize(distinct_counts(e, ["resolved"], ["run_id", "source", "ord"], "dependencyTypes"), "type-counts")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets and types that at least 1 percent of all edges have."""
    n = _type_counts(spark, d)
    total = n.where("item is null").agg(F.sum("n")).first()[0] or 0
    return n.where(F.col("item").isNotNull() & (F.col("n") * 100 >= F.lit(total))).select("resolved", F.col("item").alias("dependency_type"))


def p1_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every target and type with its number of edges."""
    return _type_counts(spark, d).where("item is not null").select("resolved", F.col("item").alias("dependency_type"), F.col("n").alias("edges"))


def p1_target_gap(spark: SparkSession, d: str) -> DataFrame:
    """Per target: edges delivered, and those less stable than the target's mean; joins a skewed side with one row per target."""
    e = table(spark, d, "edges").select(path_form(F.col("resolved")).alias("resolved"), "run_id", "source", "ord", "instability")
    lines = e.groupBy("resolved").agg(F.sum(F.round(F.col("instability") * 1000000).cast("long")).alias("s"), F.count("instability").alias("k"))
    j = skew_join(e, lines, ["resolved"], ["run_id", "source", "ord"])
    above = F.round(F.col("instability") * 1000000).cast("long") * F.col("k") > F.col("s")
    return j.groupBy("resolved").agg(F.count(F.lit(1)).alias("delivered"), F.count_if(above).alias("above_mean"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    named = graph_tables(table(spark, d, "raw_graphs"), "record_id", "body").named()
    return named.select(F.col("record").alias("record_id"), "kind", "module_ord", "dep_ord", "item_ord", "name")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    out = snapshot_changes(
        table(spark, d, "graph_snapshots"), "repo", "snapshot_id", "taken_at",
        path_form(F.col("source")), F.struct(F.col("valid").alias("v"), path_set(F.col("resolved")).alias("r")), ["delivered_at"],
    )
    return out.select("snapshot_id", F.col("key").alias("source"), "change")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    key = {"repo": F.col("repo"), "source": path_form(F.col("source")), "module": F.col("module")}
    fields = [
        Field("resolved", path_form(F.col("resolved"))),
        Field("valid", F.col("valid")),
        Field("typeOnly", F.col("typeOnly")),
        Field("dependencyTypes", name_set(F.col("dependencyTypes"))),
        Field("instability", F.col("instability"), 0.000001),
    ]
    sides = table(spark, d, "cruise_local"), table(spark, d, "cruise_ci")
    return reconcile(*sides, key, fields, "exported_at", ("only_local", "only_ci"))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of the readable bodies by kind and depth-free label, from the adjacency table."""
    nodes = shred(table(spark, d, "raw_graphs"), "record_id", "body")
    return nodes.where("kind in ('string', 'number', 'boolean')").groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_type_counts, p1_target_gap, p2_found, p2_values, p4_found, p5_found)}

_EDGE = f"SELECT run_id, source, ord, min({path_form_sql('resolved')}) AS resolved, any_value(dependencyTypes) AS ts FROM edges GROUP BY run_id, source, ord"
_TYPES = f"SELECT resolved, t AS dependency_type, count(*) AS edges FROM (SELECT resolved, unnest(list_distinct(ts)) AS t FROM ({_EDGE})) WHERE t IS NOT NULL GROUP BY ALL"


def _set_sql(c: str, form: bool = False) -> str:
    x = f"list_transform({c}, lambda x: {path_form_sql('x')})" if form else c
    return f"coalesce(list_sort(list_distinct(list_filter({x}, lambda y: y IS NOT NULL))), [])"


_SNAP = f"""WITH r AS (SELECT repo, snapshot_id, taken_at, {path_form_sql("source")} AS source, valid, {_set_sql("resolved", True)} AS res, delivered_at FROM graph_snapshots),
 h AS (SELECT repo, snapshot_id, source, valid, res FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, source ORDER BY delivered_at DESC) AS k FROM r) WHERE k = 1),
 o AS (SELECT snapshot_id, lag(snapshot_id) OVER (PARTITION BY repo ORDER BY taken_at, snapshot_id) AS prev FROM (SELECT repo, snapshot_id, min(taken_at) AS taken_at FROM r GROUP BY ALL)),
 a AS (SELECT o.snapshot_id, h.source, h.valid, h.res FROM o JOIN h USING (snapshot_id) WHERE prev IS NOT NULL),
 b AS (SELECT o.snapshot_id, h.source, h.valid, h.res FROM o JOIN h ON h.snapshot_id = o.prev)
 SELECT snapshot_id, source, CASE WHEN b.res IS NULL THEN 'added' WHEN a.res IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM a FULL JOIN b USING (snapshot_id, source) WHERE a.res IS NULL OR b.res IS NULL OR a.valid IS DISTINCT FROM b.valid OR a.res != b.res"""


def _side_sql(t: str) -> str:
    return f"""SELECT * FROM (SELECT repo, {path_form_sql("source")} AS source, module, {path_form_sql("resolved")} AS resolved, valid, typeOnly, {_set_sql("dependencyTypes")} AS ts, instability,
 row_number() OVER (PARTITION BY repo, {path_form_sql("source")}, module ORDER BY exported_at DESC) AS k FROM {t}) WHERE k = 1"""


_DIFF = f"""WITH a AS ({_side_sql("cruise_local")}), b AS ({_side_sql("cruise_ci")}),
 j AS (SELECT repo, source, module, CASE WHEN b.k IS NULL THEN ['only_local'] WHEN a.k IS NULL THEN ['only_ci'] ELSE [
 CASE WHEN a.resolved IS DISTINCT FROM b.resolved THEN 'resolved' END, CASE WHEN a.valid IS DISTINCT FROM b.valid THEN 'valid' END, CASE WHEN a.typeOnly IS DISTINCT FROM b.typeOnly THEN 'typeOnly' END,
 CASE WHEN a.ts != b.ts THEN 'dependencyTypes' END,
 CASE WHEN (a.instability IS NULL) != (b.instability IS NULL) OR abs(a.instability - b.instability) > 0.000001 THEN 'instability' END] END AS f
 FROM a FULL JOIN b USING (repo, source, module))
 SELECT repo, source, module, x AS field FROM (SELECT repo, source, module, unnest(f) AS x FROM j) WHERE x IS NOT NULL"""

# every value of a body as DuckDB's JSON tree gives it
_TREE = "t AS (SELECT record_id, j.id, j.parent, j.key, j.type, j.atom ->> '$' AS atom, j.fullkey FROM raw_graphs, json_tree(CASE WHEN json_valid(body) THEN body END) j)"


def _entries_sql(name: str, lists: str, field: str, carry: str) -> str:
    """Entries of the lists in ``lists`` (record_id, id, type, ordinals): those of an array with their place, anything else in place 0; with their names."""
    return f"""{name}_e AS (SELECT l.record_id, {carry} c.id, c.type, c.atom, CAST(c.key AS INT) AS o FROM {lists} l JOIN t c ON c.record_id = l.record_id AND c.parent = l.id WHERE l.type = 'ARRAY'
  UNION ALL SELECT l.record_id, {carry} l.id, l.type, l.atom, 0 FROM {lists} l WHERE l.type != 'ARRAY'),
 {name} AS (SELECT e.* EXCLUDE (atom), CASE WHEN e.type = 'VARCHAR' THEN e.atom ELSE f.atom END AS name FROM {name}_e e LEFT JOIN t f ON f.record_id = e.record_id AND f.parent = e.id AND e.type = 'OBJECT' AND f.key = '{field}' AND f.type = 'VARCHAR'
  WHERE e.type IN ('OBJECT', 'VARCHAR'))"""


def _below_sql(name: str, above: str, label: str, ords: str) -> str:
    return f"{name} AS (SELECT a.record_id, {ords}, c.id, c.type, c.atom FROM {above} a JOIN t c ON c.record_id = a.record_id AND c.parent = a.id AND c.key = '{label}' AND a.type = 'OBJECT')"


_DOCUMENTS = f"""WITH {_TREE},
 own AS (SELECT record_id, arg_min({{'id': id, 'type': type, 'atom': atom}}, {{'d': len(string_split(fullkey, '.')), 'i': id}}) AS x FROM t WHERE key = 'modules' AND regexp_matches(fullkey, '^\\$(\\.[^.\\[\\]]+)+$') GROUP BY record_id),
 ml AS (SELECT record_id, x.id AS id, x.type AS type, x.atom AS atom FROM own UNION ALL SELECT record_id, id, type, atom FROM t WHERE parent IS NULL AND (type = 'ARRAY' OR type = 'OBJECT' AND NOT EXISTS (SELECT 1 FROM own WHERE own.record_id = t.record_id) AND EXISTS (SELECT 1 FROM t c WHERE c.record_id = t.record_id AND c.parent = t.id AND c.key IN ('source', 'dependencies')))),
 {_entries_sql("mods", "ml", "source", "")}, {_below_sql("dl", "mods", "dependencies", "a.o AS mo, a.name AS source")}, {_entries_sql("deps", "dl", "resolved", "l.mo, l.source,")}"""
_NAMED = f"""{_DOCUMENTS},
 {_below_sql("rl", "deps", "rules", "a.mo, a.o AS d")}, {_entries_sql("rules", "rl", "name", "l.mo, l.d,")}, {_below_sql("cl", "deps", "cycle", "a.mo, a.o AS d")}, {_entries_sql("cycs", "cl", "name", "l.mo, l.d,")}
 SELECT record_id, 'module' AS kind, o AS module_ord, -1 AS dep_ord, -1 AS item_ord, name FROM mods WHERE name != '' UNION ALL SELECT record_id, 'dependency', mo, o, -1, name FROM deps WHERE name != ''
 UNION ALL SELECT record_id, 'rule', mo, d, o, name FROM rules WHERE name != '' UNION ALL SELECT record_id, 'cycle', mo, d, o, name FROM cycs WHERE name != ''"""

#: The dependencies of all readable documents (source, ord, resolved, module).
DOCUMENT_EDGES_SQL = f"""{_DOCUMENTS} SELECT d.source, CAST(d.o AS BIGINT) AS ord, d.name AS resolved, f.atom AS module
 FROM deps d LEFT JOIN t f ON f.record_id = d.record_id AND f.parent = d.id AND d.type = 'OBJECT' AND f.key = 'module' AND f.type = 'VARCHAR'"""

SQL = {
    "p2_found": _NAMED,
    "p2_values": f"WITH RECURSIVE {_TREE}, n AS (SELECT t.*, coalesce(p.type, '') AS above FROM t LEFT JOIN t p ON p.record_id = t.record_id AND p.id = t.parent), u AS (SELECT n.*, CASE WHEN above = 'ARRAY' THEN g.key ELSE n.key END AS own, g.type AS gt, g.parent AS gp FROM n LEFT JOIN t g ON g.record_id = n.record_id AND g.id = n.parent) SELECT coalesce(own, CASE WHEN gp IS NULL THEN 'modules' END) AS label, CASE WHEN type = 'VARCHAR' THEN 'string' WHEN type = 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind, count(*) AS n FROM u WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL') AND parent IS NOT NULL GROUP BY ALL",
    "p1_found": f"SELECT resolved, dependency_type FROM ({_TYPES}) WHERE edges * 100 >= (SELECT count(*) FROM ({_EDGE}))",
    "p1_type_counts": _TYPES,
    "p1_target_gap": f"""WITH e AS (SELECT {path_form_sql("resolved")} AS resolved, CAST(round(instability * 1000000) AS BIGINT) AS i FROM edges), m AS (SELECT resolved, sum(i) AS s, count(i) AS k FROM e GROUP BY resolved)
 SELECT resolved, count(*) AS delivered, count(*) FILTER (WHERE i * k > s) AS above_mean FROM e JOIN m USING (resolved) GROUP BY resolved""",
    "p4_found": _SNAP,
    "p5_found": _DIFF,
}
