"""The shell front-end."""

import json

from depweave.__main__ import main


def test_commands(spark, tmp_path, capsys):
    mod = lambda s, *to: {"source": s, "dependencies": [{"module": t, "resolved": t, "dependencyTypes": ["local"], "coreModule": False, "couldNotResolve": False, "dynamic": False} for t in to]}
    (tmp_path / "g.json").write_text(json.dumps({"modules": [mod("a/x.ts", "b/y.ts"), mod("b/y.ts", "c/z.ts"), mod("c/z.ts")]}))
    (tmp_path / "h.json").write_text(json.dumps({"modules": [mod("a/x.ts", "b/y.ts"), mod("b/y.ts"), mod("c/z.ts")]}))
    (tmp_path / "r.json").write_text(json.dumps({"forbidden": [{"name": "no", "severity": "error", "from": {"path": "^a/"}, "to": {"path": "^b/"}}]}))
    (tmp_path / "l.json").write_text(json.dumps({"forbidden": [{"name": "no", "replacedBy": "no"}]}))
    g, h, r, lint = (str(tmp_path / n) for n in ("g.json", "h.json", "r.json", "l.json"))

    def run(*argv):
        code = main(argv, spark)
        return code, capsys.readouterr().out.splitlines()

    assert run("report", g, r) == (1, ["  error no: a/x.ts → b/y.ts", "✘ 1 dependency violations (1 errors, 0 warnings). 3 modules, 2 dependencies cruised."])
    assert run("report", g, r, "--exclude", "^a/")[0] == 0
    assert run("query", g, "--to", "^c/") == (0, ["b/y.ts -> c/z.ts"])
    assert run("count", g, "--from", "^a/", "--max", "0") == (1, ["1 over 1"])
    assert run("impact", g, "c/z.ts") == (0, ["1 b/y.ts", "2 a/x.ts"])
    assert run("can-import", g, r, "c/z.ts", "a/x.ts") == (0, ["allowed circular"])
    assert run("can-import", g, r, "a/x.ts", "b/y.ts") == (1, ["forbidden acyclic no"])
    assert run("place", g, r, "new.ts", "b/y.ts") == (0, ["a no", "b legal", "c legal"])
    assert run("diff", g, h) == (0, ["removed b/y.ts -> c/z.ts"])
    assert run("lint", lint) == (1, ["no replaced-by-self"])
