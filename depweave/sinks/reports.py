"""Results as tables and text (K1-K26). Tables are distributed; only finished lines are brought to the driver.

Renderers take an iterator over ordered rows (``toLocalIterator``), so a large
result is streamed, not collected.
"""

from __future__ import annotations

import hashlib
import json
import secrets
from collections.abc import Callable, Iterable, Iterator, Mapping
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions.order import collated
from depweave.operators import metrics
from depweave.operators.evaluate import Result
from depweave.operators.graph import Graph, fan_in
from depweave.session import materialize

REPORTERS: dict[str, Callable[[Result], Iterator[str]]] = {}


def reporter(name: str) -> Callable:
    def put(f: Callable) -> Callable:
        REPORTERS[name] = f
        return f

    return put


def report(r: Result, kind: str | Callable[[Result], Iterator[str]]) -> Iterator[str]:
    """Lines of a report by name, or of a callable of one's own."""
    f = kind if callable(kind) else REPORTERS.get(kind)
    if f is None:
        raise ValueError(f"unknown report {kind!r}; there are {', '.join(sorted(REPORTERS))}")
    return f(r)


def rows(r: Result) -> Iterator:
    return r.ordered().toLocalIterator()


def document(g: Graph, strict: bool = False) -> DataFrame:
    """One JSON text per module with its dependencies in order (K1); null fields are absent. ``strict`` leaves own additions out."""
    own = {"assemblies", "size", "statements", "ord"} | ({"language", "project", "namespaces"} if strict else set())
    cols = [c for c in g.edges.columns if c not in ("source", "ord") and not (strict and c in ("dependencyKind", "line"))]
    # a module's edges are a bounded part of one source file; they are gathered per module
    deps = g.edges.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*cols).alias("d")))), lambda x: x["d"]).alias("dependencies"))
    m = g.modules.join(deps, "source", "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast(deps.schema["dependencies"].dataType)))
    keep = [c for c in m.columns if c not in own]
    return m.select("source", F.to_json(F.struct(*keep)).alias("json"))


def incidence(g: Graph) -> DataFrame:
    """Cells of the matrix in long form (K2, K9): (source, resolved, cell), the first edge of a pair in order.

    ``true`` for a valid edge, else the severity of its first rule, else
    ``undefined``. Pairs without an edge have the cell ``false`` and no row.
    """
    rules = F.col("rules") if "rules" in g.edges.columns else F.lit(None).cast("array<struct<name:string,severity:string>>")
    cell = F.when(F.coalesce("valid", F.lit(False)), "true").otherwise(F.coalesce(F.get(rules, F.lit(0))["severity"], F.lit("undefined")))
    return g.edges.withColumn("cell", cell).groupBy("source", "resolved").agg(F.min_by("cell", "ord").alias("cell"))


def matrix(g: Graph) -> Iterator[tuple[str, list[str]]]:
    """The incidence matrix row by row (K2, K9): first the names under an empty one, then each module with its cells.

    Core modules last, else by name. The header is one row as wide as the
    graph has modules; of the cells one row at a time is held.
    """
    rank = F.coalesce("coreModule", F.lit(False))
    names = [r[0] for r in g.modules.select("source", rank.alias("core_")).orderBy("core_", "source").toLocalIterator()]
    yield "", names
    at = {n: i for i, n in enumerate(names)}
    cells = incidence(g).join(g.modules.select("source", rank.alias("core_")), "source").orderBy("core_", "source").toLocalIterator()
    nxt = next(cells, None)
    for n in names:
        row = ["false"] * len(names)
        while nxt is not None and nxt["source"] == n:
            if nxt["resolved"] in at:
                row[at[nxt["resolved"]]] = nxt["cell"]
            nxt = next(cells, None)
        yield n, row


def csv(g: Graph) -> Iterator[str]:
    """The incidence matrix as text (K2), every field quoted."""
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    for name, cells in matrix(g):
        yield ",".join([quoted(name), *map(quoted, cells), '""'])


def text(g: Graph) -> DataFrame:
    """One line per edge in order (K3)."""
    m = g.modules.select("source", F.col("ord").alias("m_"))
    return g.edges.join(m, "source", "left").orderBy("m_", "source", "ord").select(F.concat_ws(" → ", "source", "resolved").alias("line"))


def metrics_table(g: Graph, order_by: str = "instability", hide: Iterable[str] = ()) -> DataFrame:
    """Folders, projects and modules with their figures (K4), most of ``order_by`` first, then by name."""
    cols = ["type", "name", "moduleCount", "afferentCouplings", "efferentCouplings", "instability"]
    f = metrics.folder_table(g).withColumn("type", F.lit("folder")).select(cols)
    p = metrics.project_table(g)[0].withColumn("type", F.lit("project")).select(cols)
    c = metrics.couplings(g)
    m = c.select(F.lit("module").alias("type"), F.col("source").alias("name"), F.lit(1).cast("bigint").alias("moduleCount"), F.col("ca").alias("afferentCouplings"), F.col("ce").alias("efferentCouplings"), "instability")
    parts = [x for n, x in (("folder", f), ("project", p), ("module", m)) if n not in hide]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.orderBy(F.desc(order_by) if order_by != "name" else F.lit(0), collated(F.col("name")), "name")


def agent(v: DataFrame, g: Graph, top: int = 5) -> DataFrame:
    """The cheapest findings of each rule (K6): score = edges to move + fan-in of the target; ties by ends.

    Ranks are limited before the exchange, so a rule with millions of findings
    sends no more than ``top`` rows from each task.
    """
    edges = F.when(F.size(F.coalesce("cycle", F.array().cast(v.schema["cycle"].dataType))) > 0, F.size("cycle")).when(F.size(F.coalesce("via", F.array().cast(v.schema["via"].dataType))) > 0, F.size("via")).otherwise(1)
    s = v.join(fan_in(g).select(F.col("resolved").alias("to"), "fan_in"), "to", "left").select("rule", "severity", "from", "to", edges.cast("bigint").alias("edgesToMove"), F.coalesce("fan_in", F.lit(0)).alias("targetFanIn"))
    s = materialize(s.withColumn("score", F.col("edgesToMove") + F.col("targetFanIn")), "agent")
    order = Window.partitionBy("rule").orderBy("score", "from", "to", "edgesToMove", "targetFanIn", "severity")
    best = s.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    counts = s.groupBy("rule").agg(F.count(F.lit(1)).alias("findings"))
    return best.join(counts, "rule").select("rule", "findings", "rank", "score", "from", "to", "edgesToMove", "targetFanIn", "severity")


def catalog(rules: Iterable[tuple[str, str]], v: DataFrame) -> DataFrame:
    """Test cases: every rule with whether it passes and its number of findings."""
    r = v.sparkSession.createDataFrame(list(rules), "rule string, severity string")
    n = v.where("severity != 'ignore'").groupBy("rule").agg(F.count(F.lit(1)).alias("findings"))
    return r.join(n, "rule", "left").select("rule", "severity", F.coalesce("findings", F.lit(0)).alias("findings"), F.col("findings").isNull().alias("passed"))


def percent(c: Column) -> Column:
    """A share as a whole percentage."""
    return F.concat(F.round(c * 100).cast("int").cast("string"), F.lit("%"))


def shown() -> Column:
    """Ends of a finding as one text."""
    way = lambda c: F.concat(F.col("from"), F.lit(" → "), F.array_join(F.transform(c, lambda s: s["name"]), " → "))
    more = F.when((F.col("type") == "instability") & F.col("from_instability").isNotNull(), F.concat(F.lit(" (instability: "), percent(F.col("from_instability")), F.lit(" → "), F.coalesce(percent(F.col("to_instability")), F.lit("0%")), F.lit(")"))).otherwise("")
    return (
        F.when(F.size(F.coalesce("cycle", F.array())) > 0, way("cycle")).when(F.size(F.coalesce("via", F.array())) > 0, way("via"))
        .when((F.col("type") == "module") | (F.col("from") == F.col("to")), F.col("from")).otherwise(F.concat(F.col("from"), F.lit(" → "), F.col("to"), more))
    )


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _service(c: Column) -> Column:
    """Text of a service message: ``|`` before quotes, bars and brackets."""
    return F.regexp_replace(F.regexp_replace(c, r"([|'\[\]])", r"\|$1"), "\n", "|n")


def _pick(values: Mapping[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.col("severity") == k, F.lit(v)).otherwise(out)
    return out


def _finding_lines() -> dict[str, Column]:
    """The line of one finding in each report that lists findings."""
    sev, rule, frm, text = F.col("severity"), F.col("rule"), F.col("from"), shown()
    # Levels of severities in each format.
    level = {"error": "error", "warn": "warning", "info": "note", "ignore": "none"}
    place = F.struct(F.struct(F.struct(frm.alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    sarif = F.struct(rule.alias("ruleId"), _pick(level, "none").alias("level"), F.struct(text.alias("text")).alias("message"), F.struct(F.col("id").alias("id")).alias("partialFingerprints"), F.array(place).alias("locations"))
    return {
        "err": F.when(sev != "ignore", F.concat(F.lit("  "), sev, F.lit(" "), rule, F.lit(": "), text)),
        "markdown": F.concat(F.lit("- "), sev, F.lit(" **"), rule, F.lit("**: "), text),
        "err-html": F.concat(F.lit('<li class="'), sev, F.lit('">'), _xml(rule), F.lit(": "), _xml(text), F.lit("</li>")),
        "sarif": F.to_json(sarif),
        "teamcity": F.concat(F.lit("##teamcity[inspection typeId='"), _service(rule), F.lit("' message='"), _service(text), F.lit("' file='"), _service(frm), F.lit("' SEVERITY='"), _pick({"error": "ERROR", "warn": "WARNING"}, "INFO"), F.lit("']")),
        "azure-devops": F.when(sev.isin("error", "warn"), F.concat(F.lit("##vso[task.logissue type="), _pick({"error": "error"}, "warning"), F.lit(";sourcepath="), frm, F.lit(";code="), rule, F.lit("]"), text)),
        "github-annotations": F.concat(F.lit("::"), _pick({"error": "error", "warn": "warning"}, "notice"), F.lit(" file="), frm, F.lit(",title="), rule, F.lit("::"), text),
    }


def finding_lines(v: DataFrame, kind: str) -> DataFrame:
    """(line) of every finding that a report lists, made where the findings are."""
    return v.select(_finding_lines()[kind].alias("line")).where("line is not null")


def _ordered(r: Result, kind: str) -> Iterator[str]:
    return (x[0] for x in r.ordered().select(_finding_lines()[kind].alias("line")).where("line is not null").toLocalIterator())


def case_lines(cases: DataFrame, kind: str) -> DataFrame:
    """(line) of every rule in the reports that have a case per rule."""
    n, rule = F.col("findings").cast("string"), F.col("rule")
    line = {
        "junit": F.concat(F.lit('<testcase name="'), _xml(rule), F.lit('">'), F.when(F.col("passed"), "").otherwise(F.concat(F.lit('<failure message="'), n, F.lit(' violations"/>'))), F.lit("</testcase>")),
        "trx": F.concat(F.lit('<UnitTestResult testName="'), _xml(rule), F.lit('" outcome="'), F.when(F.col("passed"), "Passed").otherwise("Failed"), F.lit('"/>')),
        "markdown": F.when(F.col("findings") > 0, F.concat(F.lit("| "), rule, F.lit(" | "), F.col("severity"), F.lit(" | "), n, F.lit(" |"))),
        "err-html": F.concat(F.lit("<tr><td>"), _xml(rule), F.lit("</td><td>"), F.col("severity"), F.lit("</td><td>"), n, F.lit("</td></tr>")),
    }[kind]
    return cases.select("rule", line.alias("line")).where("line is not null")


def _cases(r: Result) -> DataFrame:
    return catalog([(x.name, x.severity) for x in r.rules.all()] or [("unnamed", "warn")], r.violations)


def _case_lines(r: Result, kind: str) -> list[str]:
    return [x["line"] for x in case_lines(_cases(r), kind).orderBy("rule").collect()]


@reporter("err")
def err(r: Result, long: bool = False) -> Iterator[str]:
    """One line per finding, then totals (K5)."""
    n = 0
    for v in r.ordered().select(_finding_lines()["err"].alias("line"), "comment").where("line is not null").toLocalIterator():
        n += 1
        yield v["line"]
        if long and v["comment"]:
            yield f"    {v['comment']}"
    c, t = r.counts().first(), metrics.totals(r.graph).first()
    told = f"{t['totalCruised']} modules, {t['totalDependenciesCruised']} dependencies cruised"
    yield f"✘ {n} dependency violations ({c['error']} errors, {c['warn']} warnings). {told}." if n else f"✔ no dependency violations found ({told})"
    if c["ignore"]:
        yield f"{c['ignore']} known violations ignored."


@reporter("err-long")
def err_long(r: Result) -> Iterator[str]:
    return err(r, long=True)


@reporter("text")
def text_lines(r: Result) -> Iterator[str]:
    return (x[0] for x in text(r.graph).toLocalIterator())


@reporter("csv")
def csv_lines(r: Result) -> Iterator[str]:
    return csv(r.graph)


@reporter("json")
def json_lines(r: Result) -> Iterator[str]:
    return (x["json"] for x in document(r.graph).orderBy("source").toLocalIterator())


@reporter("metrics")
def metrics_lines(r: Result) -> Iterator[str]:
    yield f"{'type':8} {'name':60} {'N':>7} {'Ca':>7} {'Ce':>7} {'I':>5}"
    for x in metrics_table(r.graph).toLocalIterator():
        yield f"{x['type']:8} {x['name']:60} {x['moduleCount']:>7,} {x['afferentCouplings']:>7,} {x['efferentCouplings']:>7,} {round(100 * x['instability'])}%"


@reporter("agent")
def agent_lines(r: Result) -> Iterator[str]:
    for x in agent(r.violations, r.graph).orderBy("rule", "rank").toLocalIterator():
        yield json.dumps(x.asDict(), sort_keys=True, ensure_ascii=False)


@reporter("baseline")
def baseline_lines(r: Result) -> Iterator[str]:
    from depweave.operators.known import KNOWN

    keep = [c for c in KNOWN if c in r.violations.columns and c not in ("severity", "rule", "from_instability", "to_instability")]
    body = F.to_json(F.struct(*keep, F.struct(F.col("rule").alias("name"), F.col("severity")).alias("rule")))
    return (x[0] for x in r.ordered().select(body).toLocalIterator())


@reporter("markdown")
def markdown(r: Result) -> Iterator[str]:
    """Summary, rules with counts, findings (K8)."""
    c = r.counts().first()
    yield "## Forbidden dependency check - results"
    yield ""
    yield f"**{c['error']}** errors, **{c['warn']}** warnings, **{c['info']}** informational, **{c['ignore']}** ignored"
    yield ""
    yield "| rule | severity | violations |"
    yield "| --- | --- | --- |"
    yield from _case_lines(r, "markdown")
    yield ""
    yield from _ordered(r, "markdown")


@reporter("err-html")
def err_html(r: Result) -> Iterator[str]:
    """Rules with counts and findings as a page."""
    yield "<!DOCTYPE html><html><head><meta charset='utf-8'><title>dependency violations</title></head><body><table>"
    yield from _case_lines(r, "err-html")
    yield "</table><ul>"
    yield from _ordered(r, "err-html")
    yield "</ul></body></html>"


@reporter("html")
def html(r: Result) -> Iterator[str]:
    """The incidence matrix as a page (K9)."""
    yield "<!DOCTYPE html><html><head><meta charset='utf-8'><title>dependencies</title></head><body><table>"
    for i, (name, cells) in enumerate(matrix(r.graph)):
        tag = "td" if i else "th"
        yield f"<tr><th>{escape(name)}</th>" + "".join(f"<{tag}{'' if not i or c == 'false' else ' class=' + quoteattr(c)}>{escape(c)}</{tag}>" for c in cells) + "</tr>"
    yield "</table></body></html>"


@reporter("sarif")
def sarif(r: Result) -> Iterator[str]:
    """SARIF 2.1.0."""
    driver = {"name": "depweave", "rules": [{"id": x.name, "shortDescription": {"text": x.comment or x.name}} for x in r.rules.all()]}
    yield '{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": ' + json.dumps({"driver": driver}) + ', "results": ['
    for i, line in enumerate(_ordered(r, "sarif")):
        yield ("," if i else "") + line
    yield "]}]}"


@reporter("junit")
def junit(r: Result) -> Iterator[str]:
    """One case per rule."""
    cases = _cases(r).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("passed")).alias("bad")).first()
    yield f'<?xml version="1.0" encoding="UTF-8"?><testsuites><testsuite name="dependencies" tests="{cases["n"]}" failures="{cases["bad"]}">'
    yield from _case_lines(r, "junit")
    yield "</testsuite></testsuites>"


@reporter("trx")
def trx(r: Result) -> Iterator[str]:
    """One unit test result per rule."""
    yield '<?xml version="1.0" encoding="utf-8"?><TestRun xmlns="http://microsoft.com/schemas/VisualStudio/TeamTest/2010"><Results>'
    yield from _case_lines(r, "trx")
    yield "</Results></TestRun>"


@reporter("teamcity")
def teamcity(r: Result) -> Iterator[str]:
    """Service messages."""
    safe = lambda s: "".join("|" + c if c in "'|[]" else "|n" if c == "\n" else c for c in s)
    for x in r.rules.all():
        yield f"##teamcity[inspectionType id='{safe(x.name)}' name='{safe(x.name)}' description='{safe(x.comment or x.name)}' category='dependencies']"
    yield from _ordered(r, "teamcity")


@reporter("azure-devops")
def azure(r: Result) -> Iterator[str]:
    """Logging commands."""
    yield from _ordered(r, "azure-devops")
    yield f"##vso[task.complete result={'Failed' if r.counts().first()['error'] else 'Succeeded'};]"


@reporter("github-annotations")
def github(r: Result) -> Iterator[str]:
    """Workflow commands."""
    return _ordered(r, "github-annotations")


def graph_lines(g: Graph, kind: str) -> DataFrame:
    """(line, src, dst) of every pair of modules in a diagram's text; for ``mermaid`` and ``plantuml`` also of every module, with a null ``dst``."""
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    boxed = lambda c: F.concat(F.lit("["), F.col(c), F.lit("]"))
    short = lambda c: F.concat(F.lit("n"), F.substring(F.sha2(F.col(c), 256), 1, 12))
    edge = {
        "dot": F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst")), "d2": F.concat(quoted("src"), F.lit(" -> "), quoted("dst")),
        "mermaid": F.concat(F.lit("  "), short("src"), F.lit(" --> "), short("dst")), "plantuml": F.concat(boxed("src"), F.lit(" --|> "), boxed("dst")),
    }[kind]
    out = g.pairs.select(edge.alias("line"), "src", "dst")
    node = {"mermaid": F.concat(F.lit("  "), short("src"), F.lit("["), quoted("src"), F.lit("]")), "plantuml": boxed("src")}.get(kind)
    if node is None:
        return out
    ends = g.pairs.select("src").unionByName(g.pairs.select(F.col("dst").alias("src"))).distinct()
    return ends.select(node.alias("line"), "src", F.lit(None).cast("string").alias("dst")).unionByName(out)


def _drawn(g: Graph, kind: str) -> Iterator[str]:
    """Lines in order, modules first."""
    return (x["line"] for x in graph_lines(g, kind).orderBy(F.col("dst").isNotNull(), "src", "dst").toLocalIterator())


@reporter("dot")
def dot(r: Result) -> Iterator[str]:
    """GraphViz text of the graph at hand (K17); consolidate it first for folders or a pattern."""
    yield "strict digraph dependencies {"
    yield from _drawn(r.graph, "dot")
    yield "}"


@reporter("ddot")
def ddot(r: Result) -> Iterator[str]:
    from depweave.operators.filters import consolidate

    return dot(Result(consolidate(r.graph), r.rules, r.violations))


#: Fixed value: what the collapsed diagram keeps of a name unless told otherwise.
COLLAPSED = "^(packages|src|lib(s?)|app(s?)|bin|test(s?)|spec(s?))/[^/]+|node_modules/(@[^/]+/[^/]+|[^/]+)"


@reporter("cdot")
def cdot(r: Result, pattern: str = COLLAPSED) -> Iterator[str]:
    """GraphViz text of the graph collapsed to a pattern."""
    from depweave.operators.filters import consolidate

    return dot(Result(consolidate(r.graph, pattern=pattern), r.rules, r.violations))


@reporter("fdot")
def fdot(r: Result) -> Iterator[str]:
    """GraphViz text with the folders left out of the labels."""
    yield "strict digraph dependencies {"
    for x in r.graph.modules.select("source").orderBy("source").toLocalIterator():
        yield f'  "{x[0]}" [label="{x[0].rsplit("/", 1)[-1]}"]'
    yield from _drawn(r.graph, "dot")
    yield "}"


@reporter("mermaid")
def mermaid(r: Result) -> Iterator[str]:
    """Flowchart (K18); a module's id follows from its name."""
    yield "flowchart LR"
    yield from _drawn(r.graph, "mermaid")


@reporter("d2")
def d2(r: Result) -> Iterator[str]:
    """D2 text (K19)."""
    return _drawn(r.graph, "d2")


@reporter("plantuml")
def plantuml_lines(r: Result) -> Iterator[str]:
    """Component diagram."""
    yield "@startuml"
    yield from _drawn(r.graph, "plantuml")
    yield "@enduml"


def anonymize(g: Graph, words: Iterable[str] = (), keep: Iterable[str] = ("src", "lib", "test", "index", "node_modules"), key: str | None = None) -> Graph:
    """Names replaced part by part, the same everywhere (K21), no two parts by the same.

    The first parts in order become ``words``. Of the others each letter and
    digit becomes one of its class, chosen by a digest keyed with ``key`` (a
    fresh random one by default, so names can't be looked up from a word list);
    other marks stay. Where two parts would get one name, or one that is a word
    or kept, all but the first get ``~`` and a number behind it. The dictionary
    of path parts is a table, never a driver-side map; no task sees it whole.
    """
    keep, key = list(keep), key or secrets.token_hex(16)
    words = [w for w in dict.fromkeys(words) if w not in keep]
    pieces = F.split("source", r"(?<=[/.])|(?=[/.])")
    ends = g.modules.select("source").unionByName(g.edges.select(F.col("resolved").alias("source"))).distinct()
    parts = ends.select(F.explode(pieces).alias("part")).where(~F.col("part").isin("/", ".", "", *keep)).distinct()
    digit = lambda i, n: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("\n", F.lit(key), "part", i.cast("string")), 256), 1, 12), 16, 10).cast("bigint"), F.lit(n)).cast("int")
    letter = lambda i, first: F.char((digit(i, 26) + ord(first)).cast("bigint"))
    turned = F.transform(F.split("part", ""), lambda c, i: F.when(c.rlike(r"\p{Lu}"), letter(i, "A")).when(c.rlike(r"\p{L}"), letter(i, "a")).when(c.rlike(r"\p{N}"), digit(i, 10).cast("string")).otherwise(F.when(c == "~", "_").otherwise(c)))
    shaped = parts.withColumn("like", F.array_join(turned, ""))
    if words:
        first = parts.orderBy("part").limit(len(words)).withColumn("n_", F.row_number().over(Window.orderBy("part")))
        shaped = shaped.join(first, "part", "left").withColumn("word", F.get(F.array(*[F.lit(w) for w in words]), F.col("n_") - 1))
    else:
        shaped = shaped.withColumn("word", F.lit(None).cast("string"))
    nth = F.row_number().over(Window.partitionBy("like").orderBy(F.col("word").isNotNull(), F.sha2(F.concat_ws("\n", F.lit(key), "part"), 256))) + F.col("like").isin(*words, *keep, "").cast("int")
    named = shaped.withColumn("nth_", nth).select("part", F.coalesce("word", F.when(F.col("nth_") == 1, F.col("like")).otherwise(F.concat_ws("~", "like", F.col("nth_").cast("string")))).alias("new"))
    split = ends.select("source", F.posexplode(pieces).alias("p", "part")).join(named, "part", "left")
    names = split.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.coalesce("new", "part").alias("t")))), lambda x: x["t"]), "").alias("new_"))
    names = materialize(names, "names")
    m = g.modules.join(names, "source").withColumn("source", F.col("new_")).drop("new_")
    e = g.edges.join(names, "source").withColumn("source", F.col("new_")).drop("new_")
    e = e.join(names.withColumnRenamed("source", "resolved"), "resolved").withColumn("resolved", F.col("new_")).drop("new_").withColumn("module", F.col("resolved"))
    return Graph(m, e)


def attestation(files: Mapping[str, bytes]) -> str:
    """Digest over sorted names and contents of configuration, inputs and results."""
    h = hashlib.sha256()
    for n in sorted(files):
        h.update(f"{n}\n{hashlib.sha256(files[n]).hexdigest()}\n".encode())
    return h.hexdigest()


def table_digest(df: DataFrame) -> Column:
    """Order-free digest of a table's rows, combined map-side."""
    x = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    return F.concat_ws("-", F.count(F.lit(1)), F.bit_xor(x), F.sum(F.pmod(x, F.lit(1 << 31))))
