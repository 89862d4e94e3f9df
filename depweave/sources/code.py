"""Imports out of source text (S4, S6, S11-S13, S25): TypeScript and JavaScript by patterns in the JVM, Python by its own parser.

Text comes as a table of (path, text): ``read_tree`` reads files, ``tree`` takes
them from memory. What comes out are import rows, which ``graphs.resolve`` or
``resolve_python`` turn into edges.
"""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.functions.paths import normalize_dots

IMPORT = "source string, ord bigint, module string, name string, line int, kind string, typeOnly boolean, dynamic boolean"


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, text) of the files below a folder on any file system, paths relative to it."""
    base = root.rstrip("/") + "/"
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    at = F.locate(base, F.col("path"))
    return f.select(F.expr("substring(path, 1)").substr(at + len(base), F.length("path")).alias("path"), F.decode("content", "UTF-8").alias("text"))


def tree(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """The same of files in memory."""
    return spark.createDataFrame(sorted(files.items()), "path string, text string")


# a string, or a comment: comments go, strings stay
_QUOTED = r'"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
_COMMENTS = rf"({_QUOTED})|//[^\n]*|/\*[\s\S]*?\*/"
_STATEMENT = r"""(?:\b(?:import|export)\b[^'"`;()]*?\bfrom\s*|\bimport\s*(?=['"])|\b(?:require|import)\s*\(\s*)(?:"[^"\n]+"|'[^'\n]+')"""


def script_imports(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Imports of TypeScript and JavaScript files in order (S4, S6): import, export from, require, dynamic import, type-only ones.

    Comments are left out; an import statement that is written out inside a
    string would be taken for one. Null and empty texts give none.
    """
    plain = F.regexp_replace(F.col(text), _COMMENTS, "$1")
    s = files.select(F.col(path).alias("source"), F.posexplode(F.regexp_extract_all(plain, F.lit(_STATEMENT), F.lit(0))).alias("ord", "s"))
    kind = (
        F.when(F.col("s").rlike(r"^require\s*\("), "require").when(F.col("s").rlike(r"^import\s*\("), "dynamic-import").when(F.col("s").rlike(r"^export\b"), "export").otherwise("import")
    )
    module = F.regexp_extract("s", r"""["']([^"']+)["']$""", 1)
    return s.select(
        "source", F.col("ord").cast("bigint").alias("ord"), module.alias("module"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line"), kind.alias("kind"),
        F.col("s").rlike(r"^(import|export)\s+type\b").alias("typeOnly"), F.col("s").rlike(r"^import\s*\(").alias("dynamic"),
    )


def _guarded(test: ast.expr) -> bool:
    return isinstance(test, ast.Name) and test.id == "TYPE_CHECKING" or isinstance(test, ast.Attribute) and test.attr == "TYPE_CHECKING"


def imports_of(text: str | None) -> list[tuple[str, str | None, int, str, bool, bool]]:
    """(module, name, line, kind, typeOnly, dynamic) of a Python text in order (S12); unreadable texts have none.

    A relative import keeps its leading points. ``from a import b`` gives one
    row per name. Imports below a check of TYPE_CHECKING are type-only;
    ``import_module`` and ``__import__`` of a literal are dynamic.
    """
    try:
        root = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple[str, str | None, int, str, bool, bool]] = []
    todo: list[tuple[ast.AST, bool]] = [(root, False)]
    while todo:
        node, typed = todo.pop()
        if isinstance(node, ast.Import):
            out += [(a.name, None, node.lineno, "import", typed, False) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [("." * node.level + (node.module or ""), a.name, node.lineno, "import", typed, False) for a in node.names]
        elif isinstance(node, ast.Call) and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            called = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
            if called in ("import_module", "__import__"):
                out.append((node.args[0].value, None, node.lineno, "call", typed, True))
        if isinstance(node, ast.If) and _guarded(node.test):
            todo += [(c, True) for c in node.body] + [(c, typed) for c in node.orelse]
        else:
            todo += [(c, typed) for c in ast.iter_child_nodes(node)]
    return sorted(out, key=lambda r: r[2])


def python_imports(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Imports of Python files in order of their lines (S11, S12); a file is one unit of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = [(k, i, *r) for k, t in enumerate(x.column(1).to_pylist()) for i, r in enumerate(imports_of(t))]
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(cols[0], pa.int32())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds))], names=["source", "ord", "module", "name", "line", "kind", "typeOnly", "dynamic"])

    return files.select(F.col(path).alias("source"), F.col(text).alias("text")).mapInArrow(run, IMPORT)


def resolve_python(imports: DataFrame, known: DataFrame, installed: DataFrame | None = None) -> DataFrame:
    """``resolved``, ``couldNotResolve``, ``coreModule`` and ``dependencyTypes`` of Python imports.

    In this order: a local module, with the imported name or without; the
    standard library; an installed package (``installed`` has its top names in
    ``name``); a local folder that is only a namespace. Where the top name is a
    local package nothing outside is tried. One join for each form.
    """
    dotted = F.replace(F.regexp_replace("source", r"(/__init__)?\.pyi?$", ""), F.lit("/"), F.lit("."))
    local = known.where(F.col("source").rlike(r"\.pyi?$")).select(dotted.alias("dotted_"), "source").groupBy("dotted_").agg(F.min("source").alias("file_"))
    tops = local.select(F.split_part("dotted_", F.lit("."), F.lit(1)).alias("top_")).distinct()
    spaces = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("source", "/"))), lambda n: F.array_join(F.slice(F.split("source", "/"), 1, n), "."))).alias("dotted_")).distinct()
    up = F.length(F.regexp_extract("module", r"^\.+", 0))
    rest = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    # one point is the importer's own folder
    folder = F.regexp_replace("source", "/?[^/]*$", "")
    climbed = F.regexp_replace(normalize_dots(F.concat_ws("/", F.when(folder != "", folder), F.repeat(F.lit("../"), up - 1), F.when(rest != "", rest))), "/+$", "")
    base = F.when(up > 0, F.replace(climbed, F.lit("/"), F.lit("."))).otherwise(F.col("module"))
    i = imports.withColumn("base_", base).withColumn("top_", F.split_part("base_", F.lit("."), F.lit(1)))
    full = F.concat_ws(".", "base_", "name")
    i = i.join(local.select(F.col("dotted_").alias("f_"), F.col("file_").alias("named_")), full == F.col("f_"), "left").drop("f_")
    i = i.join(local.select(F.col("dotted_").alias("base_"), F.col("file_").alias("plain_")), "base_", "left")
    i = i.join(tops.withColumn("own_", F.lit(True)), "top_", "left").join(spaces.select(F.col("dotted_").alias("base_"), F.lit(True).alias("space_")), "base_", "left")
    if installed is None:
        i = i.withColumn("site_", F.lit(None).cast("boolean"))
    else:
        i = i.join(installed.select(F.col("name").alias("top_")).distinct().withColumn("site_", F.lit(True)), "top_", "left")
    file = F.coalesce("named_", "plain_")
    outside = F.col("own_").isNull() & file.isNull()
    core = outside & F.col("top_").isin(sorted(sys.stdlib_module_names))
    site = outside & ~core & F.coalesce("site_", F.lit(False))
    space = file.isNull() & ~core & ~site & F.coalesce("space_", F.lit(False))
    lost = file.isNull() & ~core & ~site & ~space
    kinds = F.when(core, F.array(F.lit("stdlib"))).when(site, F.array(F.lit("site"))).when(lost, F.array(F.lit("unresolved"))).otherwise(F.array(F.lit("local")))
    out = i.withColumn("resolved", F.coalesce(file, F.when(space, F.replace("base_", F.lit("."), F.lit("/"))), F.col("base_"))).withColumn("coreModule", core).withColumn("couldNotResolve", lost).withColumn("dependencyTypes", kinds)
    return out.select(*imports.columns, "resolved", "coreModule", "couldNotResolve", "dependencyTypes")
