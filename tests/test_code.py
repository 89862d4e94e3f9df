"""Imports out of source text."""

from pyspark.sql import functions as F

from depweave.sources.code import imports_of, python_imports, read_tree, resolve_python, script_imports, tree

TS = """// import no from "comment";
import a, { b } from './a';
import type { T } from "../t"; /* require("x") */
export * from 'lib';
import "side";
const c = require( "core" ); const url = "http://x//y";
const d = await import('./d');
export const e = 1;
"""


def test_script_imports(spark, rows):
    df = tree(spark, {"x.ts": TS, "none.ts": "", "y.js": "let s = 'a // b'; import q from 'q'"})
    got = rows(script_imports(df), "source", "ord", "module", "kind", "typeOnly", "dynamic")
    assert got == [
        ("x.ts", 0, "./a", "import", False, False), ("x.ts", 1, "../t", "import", True, False), ("x.ts", 2, "lib", "export", False, False), ("x.ts", 3, "side", "import", False, False),
        ("x.ts", 4, "core", "require", False, False), ("x.ts", 5, "./d", "dynamic-import", False, True), ("y.js", 0, "q", "import", False, False),
    ]
    assert script_imports(df.withColumn("text", F.lit(None).cast("string"))).count() == 0


PY = """import os, a.b
from . import sib
from ..c import d as e
if TYPE_CHECKING:
    from a import T
def f():
    import importlib
    importlib.import_module("dyn.x")
"""


def test_python_imports(spark, rows):
    assert imports_of(PY) == [
        ("os", None, 1, "import", False, False), ("a.b", None, 1, "import", False, False), (".", "sib", 2, "import", False, False), ("..c", "d", 3, "import", False, False), ("a", "T", 5, "import", True, False),
        ("importlib", None, 7, "import", False, False), ("dyn.x", None, 8, "call", False, True),
    ]
    assert imports_of("def (") == [] and imports_of(None) == []
    files = {"p/q/m.py": PY, "p/q/sib.py": "", "p/c/__init__.py": "", "p/c/d.py": "", "a/__init__.py": "", "a/b.py": "import a.zz\nimport numpy\nimport space.deep\nimport nothing\nfrom a import T", "space/deep/data.txt": ""}
    df = tree(spark, files)
    known = df.select(F.col("path").alias("source"))
    out = resolve_python(python_imports(df.where("path like '%.py'")), known, spark.createDataFrame([("numpy",)], "name string"))
    got = {(r["source"], r["module"], r["name"]): (r["resolved"], r["dependencyTypes"][0]) for r in out.collect()}
    assert got == {
        ("p/q/m.py", "os", None): ("os", "stdlib"), ("p/q/m.py", "a.b", None): ("a/b.py", "local"), ("p/q/m.py", ".", "sib"): ("p/q/sib.py", "local"), ("p/q/m.py", "..c", "d"): ("p/c/d.py", "local"),
        ("p/q/m.py", "a", "T"): ("a/__init__.py", "local"), ("p/q/m.py", "importlib", None): ("importlib", "stdlib"), ("p/q/m.py", "dyn.x", None): ("dyn.x", "unresolved"),
        ("a/b.py", "a.zz", None): ("a.zz", "unresolved"), ("a/b.py", "numpy", None): ("numpy", "site"), ("a/b.py", "space.deep", None): ("space/deep", "local"), ("a/b.py", "nothing", None): ("nothing", "unresolved"),
        ("a/b.py", "a", "T"): ("a/__init__.py", "local"),
    }


def test_read_tree(spark, rows, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("import './b'")
    (tmp_path / "b.md").write_text("no")
    assert rows(read_tree(spark, str(tmp_path), "*.ts")) == [("src/a.ts", "import './b'")]
