"""python -m depweave COMMAND GRAPH ...: the common questions from a shell.

    report GRAPH RULES [--kind err] [--exclude P] [--include-only P] [--focus P] [--collapse P]
    query GRAPH [--from P] [--to P]         count GRAPH [--from P] [--to P] [--max N]
    impact GRAPH FILE [--depth N]           can-import GRAPH RULES FROM TO
    place GRAPH RULES NAME TARGET...        diff OLD NEW
    lint RULES

GRAPH is a saved document; RULES are JSON or YAML. ``report`` ends with the
number of errors, ``count`` with 1 above its ceiling, ``can-import`` with 1 if
a rule forbids the edge, ``lint`` with 1 if it finds something.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from depweave.operators import evaluate as ev, filters, whatif as wi
from depweave.plans import rules as ru
from depweave.sinks import reports as rp
from depweave.sources.graphs import read_document


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="depweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, many: str | None = None, **options: type) -> None:
        c = sub.add_parser(name)
        for x in places:
            c.add_argument(x)
        if many:
            c.add_argument(many, nargs="+")
        for o, kind in options.items():
            c.add_argument("--" + o.rstrip("_").replace("_", "-"), type=kind, dest=o)

    command("report", "graph", "rules", kind=str, exclude=str, include_only=str, focus=str, collapse=str)
    command("query", "graph", from_=str, to=str)
    command("count", "graph", from_=str, to=str, max=int)
    command("impact", "graph", "file", depth=int)
    command("can-import", "graph", "rules", "source", "target")
    command("place", "graph", "rules", "name", many="targets")
    command("diff", "old", "new")
    command("lint", "rules")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs one command, prints its lines and gives its exit code."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("depweave").getOrCreate()
    rules = ru.load(Path(a.rules).read_text()) if getattr(a, "rules", None) else None
    g = read_document(spark, a.graph) if getattr(a, "graph", None) else None
    say = lambda rows: [print(*r) for r in rows]
    if a.command == "report":
        g = filters.apply_filters(g, {"exclude": a.exclude, "includeOnly": a.include_only, "focus": a.focus})
        if a.collapse:
            g = filters.consolidate(g, pattern=filters.collapse_pattern(a.collapse))
        r = ev.evaluate(g.saved(), rules)
        say((line,) for line in rp.report(r, a.kind or "err"))
        return r.exit_code()
    if a.command == "query":
        say((x["from"], "->", x["to"]) for x in wi.query(g, a.from_, a.to).orderBy("from", "to").toLocalIterator())
    elif a.command == "count":
        n, verdict, by = wi.count(g, a.from_, a.to, a.max)
        say([(n, verdict, *([] if by is None else [by]))])
        return int(verdict == "over")
    elif a.command == "impact":
        files = spark.createDataFrame([(a.file,)], "file string")
        say((x["level"], x["dependent"]) for x in wi.impact(g, files, a.depth or 0).orderBy("level", "dependent").toLocalIterator())
    elif a.command == "can-import":
        x = wi.can_import(g, rules, spark.createDataFrame([(a.source, a.target)], "`from` string, `to` string")).first()
        say([("allowed" if x["allowed"] else "forbidden", "circular" if x["circular"] else "acyclic", *x["rules"])])
        return int(not x["allowed"])
    elif a.command == "place":
        say((x["folder"], "legal" if x["legal"] else ",".join(x["rules"])) for x in wi.place(g, rules, a.name, a.targets).orderBy("folder").toLocalIterator())
    elif a.command == "diff":
        old, new = read_document(spark, a.old), read_document(spark, a.new)
        say((x["change"], x["from"], "->", x["to"]) for x in wi.diff_edges(old, new).orderBy("change", "from", "to").toLocalIterator())
    else:
        found = ru.lint(rules) + ru.repeats(rules)
        say(found)
        return int(bool(found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
