"""Reading graphs: saved documents, edge tables, declared edges, fleets, change lists."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions import regex
from depweave.functions.order import sort_versions
from depweave.functions.paths import normalize_dots
from depweave.operators.graph import EDGE_COLUMNS, MODULE_COLUMNS, Graph, complete
from depweave.plans.rules import parse

_NAMED = "array<struct<name:string,severity:string>>"
_STEP = "array<struct<name:string,dependencyTypes:array<string>>>"
DOCUMENT = f"""
modules array<struct<source:string,valid:boolean,orphan:boolean,followable:boolean,matchesDoNotFollow:boolean,coreModule:boolean,couldNotResolve:boolean,consolidated:boolean,
  language:string,project:string,namespaces:array<string>,instability:double,license:string,checksum:string,dependents:array<string>,rules:{_NAMED},experimentalStats:struct<topLevelStatementCount:bigint,size:bigint>,
  dependencies:array<struct<module:string,resolved:string,moduleSystem:string,dependencyTypes:array<string>,dependencyKind:string,coreModule:boolean,followable:boolean,dynamic:boolean,exoticallyRequired:boolean,exoticRequire:string,
    couldNotResolve:boolean,circular:boolean,valid:boolean,matchesDoNotFollow:boolean,preCompilationOnly:boolean,typeOnly:boolean,license:string,instability:double,cycle:{_STEP},line:int,rules:{_NAMED},declared:boolean,comment:string>>>>
"""
VIOLATIONS = f"type string, `from` string, `to` string, unresolvedTo string, dependencyTypes array<string>, rule struct<name:string,severity:string>, cycle {_STEP}, via {_STEP}, id string, expires date, owner string, reason string"

# Languages by file ending.
ENDINGS = {"typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs vue svelte", "dotnet": "cs vb fs", "python": "py pyi"}


def language(c: Column) -> Column:
    """Language by a path's ending, null for others (S3)."""
    out = F.lit(None).cast("string")
    for name, ends in ENDINGS.items():
        out = F.when(F.lower(c).rlike(rf"\.({'|'.join(ends.split())})\z"), name).otherwise(out)
    return out


def _exploded(doc: DataFrame) -> Graph:
    m = doc.select(F.posexplode("modules").alias("ord", "m"))
    stats = "m.experimentalStats"
    flat = [c for c in MODULE_COLUMNS if c not in ("ord", "assemblies", "size", "statements")]
    modules = m.select(F.col("ord").cast("bigint").alias("ord"), *[F.col(f"m.{c}").alias(c) for c in flat], F.col(f"{stats}.size").alias("size"), F.col(f"{stats}.topLevelStatementCount").alias("statements"), F.col("m.rules").alias("rules"))
    modules = modules.withColumn("language", F.coalesce("language", language(F.col("source"))))
    edges = m.select(F.col("m.source").alias("source"), F.posexplode("m.dependencies").alias("ord", "d")).select("source", F.col("ord").cast("bigint").alias("ord"), "d.*")
    return Graph(complete(modules, MODULE_COLUMNS), complete(edges, EDGE_COLUMNS))


def read_document(spark: SparkSession, path: str) -> Graph:
    """A saved result or an upstream tool's JSON as a graph (S1, S2). Missing fields are null, not false."""
    return _exploded(spark.read.schema(DOCUMENT).json(path, multiLine=True))


def from_json(df: DataFrame, body: str) -> Graph:
    """A graph from a column of documents that are each read by the schema; unreadable ones give nothing."""
    return _exploded(df.select(F.from_json(F.col(body), DOCUMENT).alias("d")).where("d.modules is not null").select("d.modules"))


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """A known-violations file (S23): one JSON array."""
    return spark.read.schema(VIOLATIONS).json(path, multiLine=True).withColumn("severity", F.col("rule.severity")).withColumn("rule", F.col("rule.name"))


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Snapshot table and its versions, oldest first."""
    s = spark.read.parquet(path)
    return s, sort_versions([str(r[0]) for r in s.select("version").distinct().collect()])


def gather(df: DataFrame, path: str, extensions: Sequence[str] = (), include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Source files of a listing by ending and patterns."""
    if extensions:
        df = df.where(F.lower(path).rlike(rf"\.({'|'.join(re.escape(e.lstrip('.')) for e in extensions)})\z"))
    if include:
        df = df.where(regex.matches(F.col(path), include))
    return df.where(~regex.matches(F.col(path), exclude)) if exclude else df


def resolve(imports: DataFrame, known: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Specifiers against known sources (S7, S13): relative to the importer, by alias, then as written with usual endings.

    ``imports`` is (source, module); adds ``resolved`` and ``couldNotResolve``.
    One equi-join per form; the first form that is known decides.
    """
    spec = F.col("module")
    for a, b in (aliases or {}).items():
        spec = F.when(spec.startswith(a), F.concat(F.lit(b), F.substring(spec, len(a) + 1, 10_000))).otherwise(spec)
    folder = F.regexp_replace("source", "[^/]*$", "")
    base = F.when(F.col("module").rlike(r"^\.\.?(/|$)"), normalize_dots(F.concat(folder, F.col("module")))).otherwise(spec)
    forms = ["", ".ts", ".tsx", ".js", ".py", "/index.ts", "/index.js", "/__init__.py"]
    i = imports.withColumn("i_", F.xxhash64("source", "module")).withColumn("b_", base)
    tries = i.select("source", "module", F.posexplode(F.array(*[F.concat("b_", F.lit(f)) for f in forms])).alias("p_", "t_"))
    hit = tries.join(known.select(F.col("source").alias("t_")).distinct(), "t_").groupBy("source", "module").agg(F.min_by("t_", "p_").alias("resolved"))
    return imports.join(hit, ["source", "module"], "left").withColumn("couldNotResolve", F.col("resolved").isNull()).withColumn("resolved", F.coalesce("resolved", "module"))


def edge_types(core: Sequence[str]) -> Column:
    """Kinds of an edge by its target (S8): core, unknown, npm, local."""
    target = F.col("resolved")
    return F.when(F.col("module").isin(list(core)), F.array(F.lit("core"))).when(F.col("couldNotResolve"), F.array(F.lit("unknown"))).when(target.contains("node_modules/"), F.array(F.lit("npm"))).when(F.col("module").rlike(r"^[./]"), F.array(F.lit("local"))).otherwise(F.array(F.lit("undetermined")))


def merge(*graphs: Graph) -> Graph:
    """Graphs of several extractors one after another (S14): module order continues from part to part."""
    modules = edges = None
    for i, g in enumerate(graphs):
        m = g.modules.withColumn("ord", F.coalesce("ord", F.lit(0)) + F.lit(i).cast("bigint") * F.lit(1 << 40))
        modules = m if modules is None else modules.unionByName(m, allowMissingColumns=True)
        edges = g.edges if edges is None else edges.unionByName(g.edges, allowMissingColumns=True)
    return Graph(modules, edges)


def read_declared(spark: SparkSession, text: str) -> DataFrame:
    """Hand-written edges (S15): (from, to, module, kind, comment)."""
    rows = [(d["from"], d["to"], d["to"], d.get("kind"), d.get("comment")) for d in parse(text).get("declared", ())]
    return spark.createDataFrame(rows, "`from` string, `to` string, module string, kind string, comment string")


METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def read_openapi(spark: SparkSession, text: str) -> DataFrame:
    """(operation, method, path, handler) of an OpenAPI document (S27); path items behind a reference are not followed."""
    rows = []
    for path, item in (parse(text).get("paths") or {}).items():
        if isinstance(item, dict) and "$ref" not in item:
            for m in METHODS:
                if isinstance(item.get(m), dict):
                    op = item[m]
                    rows.append((op.get("operationId"), m.upper(), path, op.get("x-handler") or item.get("x-handler")))
    return spark.createDataFrame(rows, "operation string, method string, path string, handler string")


def client_names(types: DataFrame, members: DataFrame, folder: str) -> DataFrame:
    """(file, name) declared below a client's folder."""
    t = types.select(F.explode("files").alias("file"), "name")
    m = members.join(types.select(F.col("fullName").alias("declaringType"), "files"), "declaringType").select(F.explode("files").alias("file"), members["name"])
    return t.unionByName(m).where(F.col("file").startswith(folder.rstrip("/") + "/")).distinct()


def openapi_edges(operations: DataFrame, clients: DataFrame, base: str) -> DataFrame:
    """Edges from the modules that name an operation to its handler."""
    ops = operations.where("operation is not null and handler is not null")
    j = ops.join(clients, ops["operation"] == clients["name"])
    note = F.concat(F.lit("operation "), F.col("operation"), F.lit(" ("), F.col("method"), F.lit(" "), F.col("path"), F.lit(")"))
    return j.select(F.col("file").alias("from"), normalize_dots(F.concat(F.lit(base.rstrip("/") + "/"), "handler")).alias("to"), F.col("operation").alias("module"), F.lit("openapi").alias("kind"), note.alias("comment")).distinct()


def apply_declared(g: Graph, declared: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph with the declared edges whose ends exist, and the others."""
    known = g.modules.select("source").distinct()
    a, b = known.select(F.col("source").alias("from")), known.select(F.col("source").alias("to"))
    good = declared.join(a, "from", "left_semi").join(b, "to", "left_semi")
    bad = declared.join(good.select("from", "to", "module").distinct(), ["from", "to", "module"], "left_anti")
    new = good.select(
        F.col("from").alias("source"), (F.xxhash64("to", "module").bitwiseAND(F.lit((1 << 40) - 1)) + F.lit(1 << 41)).alias("ord"), F.col("to").alias("resolved"), "module",
        F.array(F.lit("local")).alias("dependencyTypes"), F.lit("declared").alias("dependencyKind"), F.lit(False).alias("coreModule"), F.lit(False).alias("couldNotResolve"), F.lit(True).alias("followable"),
    )
    return g.with_(edges=g.edges.unionByName(complete(new, EDGE_COLUMNS), allowMissingColumns=True)), bad


def read_fleet(text: str) -> tuple[list[dict], dict]:
    """Repositories and fleet rules of a manifest."""
    d = parse(text)
    repos = [r if isinstance(r, dict) else {"name": r, "path": r} for r in d.get("repos", ())]
    if len({r["name"] for r in repos}) != len(repos):
        raise ValueError("repository names must be unique")
    return repos, d.get("rules", {})


# Change letters of a name-status listing.
CHANGES = {"A": "added", "C": "copied", "D": "deleted", "M": "modified", "R": "renamed", "T": "type changed", "U": "unmerged", "X": "unknown", "B": "pairing broken"}
# Change letters of a status listing.
STATUS = CHANGES | {" ": "unmodified", "?": "untracked", "!": "ignored"}


def _kind(c: Column, kinds: Mapping[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), c)


def diff_lines(lines: DataFrame, line: str) -> DataFrame:
    """(path, kind, old_path) of ``diff --name-status`` lines (S21, S22); lines of another shape are skipped."""
    shape = r"^([ACDMRTUXB])(?:[0-9]{3})?[ \t]+(\S+)(?:[ \t]+(\S+))?\s*$"
    x = lines.where(F.col(line).rlike(shape))
    a, b = F.regexp_extract(line, shape, 2), F.regexp_extract(line, shape, 3)
    return x.select(F.when(b != "", b).otherwise(a).alias("path"), _kind(F.regexp_extract(line, shape, 1), CHANGES).alias("kind"), F.when(b != "", a).alias("old_path"))


def status_lines(lines: DataFrame, line: str) -> DataFrame:
    """The same of ``status --porcelain`` lines: the staged letter unless it is unmodified."""
    shape = r"^([ ACDMRTUXB?!])([ ACDMRTUXB?!]) (\S+)(?: -> (\S+))?\s*$"
    x = lines.where(F.col(line).rlike(shape))
    s, w, a, b = (F.regexp_extract(line, shape, i) for i in (1, 2, 3, 4))
    return x.select(F.when(b != "", b).otherwise(a).alias("path"), _kind(F.when(s == " ", w).otherwise(s), STATUS).alias("kind"), F.when(b != "", a).alias("old_path"))


def replace_changed(old: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """Incremental extraction (T5, T6): rows of re-read files take the place of the old ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def attribute_files(types: DataFrame, pdb: DataFrame, inferred: DataFrame) -> DataFrame:
    """(fullName, file, attribution): a type's file from debug documents, else inferred."""
    j = types.select("fullName").join(pdb.select("fullName", F.col("file").alias("p")), "fullName", "left").join(inferred.select("fullName", F.col("file").alias("i")), "fullName", "left")
    return j.select("fullName", F.coalesce("p", "i").alias("file"), F.when(F.col("p").isNotNull(), "pdb").when(F.col("i").isNotNull(), "inferred").otherwise("none").alias("attribution"))


def document_json(document: dict) -> str:
    """Stable text of a small driver-side document: sorted keys."""
    return json.dumps(document, sort_keys=True, ensure_ascii=False)
