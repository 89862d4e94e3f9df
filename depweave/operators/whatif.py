"""Questions about a graph: query, can-import, impact, place, diff, changelog, snapshot, fleet, affected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions import regex
from depweave.functions.order import precedence, sort_versions
from depweave.functions.paths import dirname, parents
from depweave.operators import metrics
from depweave.operators.evaluate import Result, evaluate, expired, rule_counts, severity_counts, vacuous
from depweave.operators.graph import EDGE_COLUMNS, MODULE_COLUMNS, Graph, complete, meets, reach, reach_set
from depweave.operators.known import ratchet_counts, ratchet_predicate
from depweave.plans.compile import edge_predicate, needs, path_pair, verdicts
from depweave.plans.rules import From, Ratchet, Rule, RuleSet, To
from depweave.session import materialize


def query(g: Graph, frm: str | None = None, to: str | None = None, from_not: str | None = None, to_not: str | None = None) -> DataFrame:
    """Direct edges by patterns, captures included (Q1)."""
    r = Ratchet("query", From(path=frm, pathNot=from_not), To(path=to, pathNot=to_not))
    return g.edges.where(ratchet_predicate(r)).select(F.col("source").alias("from"), F.col("resolved").alias("to"))


def count(g: Graph, frm: str | None = None, to: str | None = None, ceiling: int | None = None) -> tuple[int, str, int | None]:
    """(count, verdict, headroom or excess) of direct edges against a ceiling (Q2)."""
    row = ratchet_counts(g, [Ratchet("count", From(path=frm), To(path=to), ceiling)]).first()
    return row["count"], row["verdict"], row["by"]


def candidate_edges(candidates: DataFrame, g: Graph) -> DataFrame:
    """Candidate (from, to) pairs as edges: facts of the target come from what other edges and modules say about it."""
    about = g.modules.select(F.col("source").alias("resolved"), "coreModule", "couldNotResolve", "followable", "instability")
    e = candidates.select(F.col("from").alias("source"), F.col("to").alias("resolved")).distinct().join(about, "resolved", "left")
    known = F.col("coreModule").isNotNull()
    e = e.withColumn("module", F.col("resolved")).withColumn("dependencyTypes", F.when(known, F.array(F.lit("local"))).otherwise(F.array(F.lit("unknown")))).withColumn("dependencyKind", F.lit("import")).withColumn("dynamic", F.lit(False)).withColumn("exoticallyRequired", F.lit(False))
    e = e.withColumn("couldNotResolve", F.coalesce("couldNotResolve", ~known)).withColumn("coreModule", F.coalesce("coreModule", F.lit(False)))
    return complete(e.withColumn("ord", (F.row_number().over(Window.partitionBy("source").orderBy("resolved")) + 1_000_000_000).cast("bigint")), EDGE_COLUMNS)


def can_import(g: Graph, rules: RuleSet, candidates: DataFrame) -> DataFrame:
    """(from, to, allowed, circular, rules) for many hypothetical edges at once.

    An edge would be circular if its target reaches its source already. All
    targets are walked together, each until it has met its sources.
    """
    c = materialize(candidates.select("from", "to").distinct(), "candidates")
    back = meets(g.pairs, c.select(F.col("to").alias("seed"), F.col("from").alias("node")))
    loop = back.select(F.col("seed").alias("to"), F.col("node").alias("from")).unionByName(c.where("`from` = `to`"), allowMissingColumns=True).select("from", "to").distinct().withColumn("circular", F.lit(True))
    e = candidate_edges(c, g).drop("circular").join(loop.select(F.col("from").alias("source"), F.col("to").alias("resolved"), "circular"), ["source", "resolved"], "left").withColumn("circular", F.coalesce("circular", F.lit(False)))
    from depweave.operators.evaluate import dependency_violations

    v = dependency_violations(g.with_(edges=complete(e, EDGE_COLUMNS)), rules)
    told = v.groupBy("from", "to").agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.bool_or(F.col("severity") == "error").alias("error_"))
    out = c.join(loop, ["from", "to"], "left").join(told, ["from", "to"], "left")
    return out.select("from", "to", (~F.coalesce("error_", F.lit(False))).alias("allowed"), F.coalesce("circular", F.lit(False)).alias("circular"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))


def impact(g: Graph, files: DataFrame, depth: int = 0) -> DataFrame:
    """(file, dependent, level): who depends on each file, to a depth."""
    back = g.pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    r = reach(back, files.select(F.col("file").alias("seed"), F.col("file").alias("node")), depth)
    return r.where("seed != node").select(F.col("seed").alias("file"), F.col("node").alias("dependent"), "level")


def rules_mentioning(rules: RuleSet, files: DataFrame) -> DataFrame:
    """(file, rule, side): an open ``from`` concerns every file, an open ``to`` none (Q6). One pass over the files for all rules."""
    f = F.col("file")

    def side(path: str | None, path_not: str | None, open_: bool) -> Column:
        if path is None and path_not is None:
            return F.lit(open_)
        return path_pair(f, path, path_not)

    told = []
    for r in rules.all():
        a = side(*r.selecting, True)
        b = side(r.to.path, r.to.pathNot, False)
        where = F.when(a & b, "from and to").when(a, "from").when(b, "to")
        told.append(F.when(where.isNotNull(), F.struct(F.lit(r.name).alias("rule"), where.alias("side"))))
    if not told:
        return files.select("file", F.lit("").alias("rule"), F.lit("").alias("side")).limit(0)
    return files.select("file", F.explode(F.array_compact(F.array(*told))).alias("x")).select("file", "x.rule", "x.side")


def place_candidates(g: Graph, language: str | None = None) -> DataFrame:
    """(folder): every folder of the language's modules and its ancestors (Q8)."""
    m = g.modules.where(metrics.calculable())
    if language:
        m = m.where(F.col("language") == language)
    return m.select(F.explode(parents(dirname(F.col("source")))).alias("folder")).distinct()


def place(g: Graph, rules: RuleSet, name: str, targets: Sequence[str], language: str | None = None) -> DataFrame:
    """(folder, legal, rules): where a new module with some imports could lie (Q7). All folders are judged in one pass."""
    folders = place_candidates(g, language)
    source = F.when(F.col("folder") == ".", F.lit(name)).otherwise(F.concat_ws("/", F.col("folder"), F.lit(name)))
    pairs = folders.select("folder", source.alias("from"), F.explode(F.array(*[F.lit(t) for t in targets])).alias("to"))
    pairs = materialize(pairs, "places")
    told = can_import(g, rules, pairs.select("from", "to"))
    j = pairs.join(told, ["from", "to"])
    return j.groupBy("folder").agg(F.bool_and("allowed").alias("legal"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"))


def folder_distance(a: Column, b: Column) -> Column:
    """Folders between two folders: up to the shared one and down again (Q10); an empty name is the root."""
    x, y = (F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "/")) for c in (a, b))
    differ = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(x), F.size(y)), F.lit(1))), lambda i: F.coalesce(F.get(x, i - 1) == F.get(y, i - 1), F.lit(False))), False)
    shared = F.when(differ > 0, differ - 1).otherwise(F.least(F.size(x), F.size(y)))
    return (F.size(x) + F.size(y) - 2 * shared).cast("int")


#: Distances up to which candidate folders are tried together; whoever has none goes on to the next. A module between two folders is as far from both as they are from each other, or farther. Moves come a turn later, when few are left that could still be the cheapest.
_RINGS = {"move": (0, 0, 1, 2, 3, 4, 6, 8, 1 << 20), "port": (-1, 0, 2, 4, 8, 1 << 20)}
_RANK = {"move": 0, "port": 1, "invert": 2}


def _ways_up(c: Column) -> Column:
    """The folders above a folder and itself, from the root on, each with its depth; an empty name is the root."""
    parts = F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("j_"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("up_")))


def _near(left: DataFrame, folders: DataFrame, plan: str, low: int, high: int, deepest: int) -> DataFrame:
    """``left`` with the folders in reach and how far ``away`` they are: above ``low``, up to ``high``.

    A folder is met once, under the deepest folder above it that lies on the
    way up from the violation's ends, and only at the depths that the distance
    allows.
    """
    at = lambda c: F.get(F.transform(F.col(c), lambda x: x["up_"]), F.col("j_") + 1)
    da, db = F.size("wa_") - 1, F.size("wb_") - 1
    if plan == "move":
        near, per, base = left.withColumn("x_", F.explode("wa_")), 1, da - 2 * F.col("x_.j_")
    else:
        near, per = left.withColumn("x_", F.explode(F.array_union("wa_", "wb_"))), 2
        base = da + db - 2 * F.col("x_.j_") - 2 * F.least(F.col("x_.j_"), ((da + db - F.col("apart_")) / 2).cast("int"))
        low, high = F.col("apart_") + low, F.col("apart_") + high
    near = near.withColumns({"base_": base, "j_": F.col("x_.j_"), "up_": F.col("x_.up_")})
    depth = lambda most: F.floor((F.lit(most) - F.col("base_")) / per).cast("int")
    near = near.withColumns({"least_": F.greatest(F.col("j_"), depth(low) + 1), "most_": F.least(F.lit(deepest), depth(high)), "na_": at("wa_"), "nb_": at("wb_") if plan == "port" else F.lit(None).cast("string")}).where("least_ <= most_")
    near = near.withColumn("df_", F.explode(F.sequence("least_", "most_"))).withColumn("away", (F.col("base_") + per * F.col("df_")).cast("int")).drop("x_", "wa_", "wb_", "least_", "most_")
    same = (near["up_"] == folders["up_"]) & (near["j_"] == folders["j_"]) & (near["df_"] == folders["df_"]) & near["la_"].eqNullSafe(folders["language"])
    return near.join(folders, same).where("next_ is null or (not next_ <=> na_ and not next_ <=> nb_)")


#: Names up to which all tasks get them, to look for edges that touch one; more are joined.
_FEW = 200_000


def _touching_ends(g: Graph, ends: DataFrame) -> DataFrame:
    """The edges from or to some names (end_), written once."""
    ends = materialize(ends, "ends")
    if ends.limit(_FEW + 1).count() <= _FEW:
        ends = F.broadcast(ends)
    side = lambda c, flag: ends.select(F.col("end_").alias(c), F.lit(True).alias(flag))
    e = g.edges.join(side("source", "from_end_"), "source", "left").join(side("resolved", "to_end_"), "resolved", "left")
    return materialize(e.where("from_end_ or to_end_").select(*g.edges.columns), "touching")


def fix_plans(g: Graph, rules: RuleSet, violations: DataFrame) -> DataFrame:
    """(from, to, rule, plan, target, cost): the cheapest way out of each violation that the rules allow (Q9, A.10).

    The edge to change is the violation's own, or the first step of a
    reachability path. ``move`` puts the source into another folder (cost: its
    imports and importers), ``port`` puts a module between on which both ends
    depend (cost 2), ``invert`` turns the edge (cost 1, 1 for the new edge and
    the target's other importers). Folders are those of the language's modules
    and their ancestors but the root, nearest first, then deeper, then by name;
    a name that is taken is passed over. Equal cost: move, port, invert.

    A plan is legal if no error rule blocks an edge it adds and an evaluation
    no longer reports the violation, adds no error and no finding of the same
    rule. Where all rules look at single edges, only the edges a plan changes
    can be judged otherwise, so all plans are judged together; else each plan
    is evaluated on a graph of its own, one after another.
    """
    via = F.get("via", 0)["name"] if "via" in violations.columns else F.lit(None).cast("string")
    v = violations.where(F.col("type").isin("dependency", "cycle", "instability", "reachability"))
    v = v.select("from", "to", "rule", F.when(F.col("type") == "reachability", via).otherwise(F.col("to")).alias("b")).distinct().withColumn("a", F.col("from"))
    own = g.modules.where(metrics.calculable()).select("source", "language")
    v = v.join(own.select(F.col("source").alias("a"), F.col("language").alias("la_")), "a").join(own.select(F.col("source").alias("b"), F.col("language").alias("lb_"), F.lit(True).alias("local_")), "b", "left")
    v = materialize(v, "ends")
    near = g.with_(edges=_touching_ends(g, v.select(F.explode(F.array("a", "b")).alias("end_")).where("end_ is not null").distinct()))
    pairs = near.pairs.where("src != dst")
    outs = near.edges.groupBy(F.col("source").alias("a")).agg(F.count(F.lit(1)).alias("out_"))
    ins = lambda c, n: pairs.groupBy(F.col("dst").alias(c)).agg(F.count(F.lit(1)).alias(n))
    back = pairs.select(F.col("src").alias("b"), F.col("dst").alias("a"), F.lit(1).alias("back_"))
    v = v.join(outs, "a", "left").join(ins("a", "in_a"), "a", "left").join(ins("b", "in_b"), "b", "left").join(back, ["a", "b"], "left")
    home = lambda c: F.when(dirname(F.col(c)) == ".", "").otherwise(dirname(F.col(c)))
    v = materialize(v.fillna(0, ["out_", "in_a", "in_b", "back_"]).withColumns({"ha_": home("a"), "hb_": home("b")}), "to-fix")
    folder = own.select("language", dirname(F.col("source")).alias("dir_")).distinct().select("language", F.explode(parents(F.col("dir_"))).alias("folder")).where("folder not in ('.', '/', '')").distinct()
    folder = folder.withColumn("w_", _ways_up(F.col("folder"))).withColumn("x_", F.explode("w_")).withColumn("next_", F.get("w_", F.col("x_.j_") + 1)["up_"])
    folders = materialize(folder.select("folder", "language", (F.size("w_") - 1).alias("df_"), "x_.j_", "x_.up_", "next_"), "folders")
    deepest = folders.agg(F.max("df_")).first()[0] or 0
    base = materialize(violations.where("severity != 'ignore'").select(F.col("from").alias("f_"), F.col("to").alias("t_"), F.col("rule").alias("r_"), "type").distinct(), "base")
    # rules about single edges need no edges but those of the violations' ends
    together = not needs(rules) and not any(r.family != "dependency" for r in rules.all()) and not rules.required
    judge, seen = (_judge_together, near) if together else (_judge_alone, g)
    keys = ["from", "to", "rule"]
    name = {"move": F.regexp_extract("a", "[^/]+$", 0), "port": F.concat(F.lit("port-"), F.regexp_extract("b", "[^/]+$", 0))}
    both = F.coalesce("local_", F.lit(False)) & F.col("la_").eqNullSafe(F.col("lb_"))
    cost = {"move": F.col("out_") + F.col("in_a"), "port": F.lit(2), "invert": F.lit(2) - F.col("back_") + F.col("in_b") - F.lit(1)}
    inverted = v.where(F.coalesce("local_", F.lit(False))).select(*keys, "a", "b", "la_", F.lit("invert").alias("plan"), F.col("a").alias("target"), cost["invert"].cast("bigint").alias("cost"), F.lit(0).alias("away"), F.lit(0).alias("deep"))
    rank = F.when(F.col("plan") == "move", _RANK["move"]).when(F.col("plan") == "port", _RANK["port"]).otherwise(_RANK["invert"])
    found = []
    v = v.withColumns({"wa_": _ways_up(F.col("ha_")), "wb_": _ways_up(F.col("hb_")), "apart_": folder_distance(F.col("ha_"), F.col("hb_"))})
    left = {"move": v, "port": v.where(both)}
    for i in range(max(map(len, _RINGS.values())) - 1):
        left = {plan: df for plan, df in left.items() if i + 1 < len(_RINGS[plan]) and not df.isEmpty()}
        if i and not left:
            break
        tried = None if i else inverted
        for plan, df in left.items():
            at = _near(df, folders, plan, *_RINGS[plan][i : i + 2], deepest)
            at = at.withColumn("target", F.concat_ws("/", "folder", name[plan])).join(g.modules.select(F.col("source").alias("target")), "target", "left_anti")
            at = at.select(*keys, "a", "b", "la_", F.lit(plan).alias("plan"), "target", cost[plan].cast("bigint").alias("cost"), "away", (-F.size(F.split("folder", "/"))).alias("deep"))
            tried = at if tried is None else tried.unionByName(at)
        good = materialize(judge(seen, rules, materialize(tried, "plans"), base), "legal")
        found.append(good)
        done = good.groupBy(*keys).agg(F.min(F.struct("cost", rank.alias("p_"))).alias("done_"))
        # what costs no less than a plan that is found need not be looked for
        less = lambda plan: F.col("done_").isNull() | (F.struct(cost[plan].cast("bigint").alias("cost"), F.lit(_RANK[plan]).alias("p_")) < F.col("done_"))
        left = {plan: materialize(df.join(done, keys, "left").where(less(plan)).drop("done_"), "to-fix") for plan, df in left.items()}
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    best = out.groupBy(*keys).agg(F.min(F.struct("cost", rank.alias("p_"), "away", "deep", "target", "plan")).alias("x"))
    return best.select(*keys, "x.plan", "x.target", "x.cost")


def _added(g: Graph, plans: DataFrame, own: bool = False) -> DataFrame:
    """Edges that plans add, with the names they had before: the plans' columns and (s_, t_, s0_, t0_, real_) of each.

    With ``own``, of the edges that move only the one that is to be changed.
    """
    move, port, turn = (plans.where(F.col("plan") == p) for p in ("move", "port", "invert"))
    e = g.edges.select(F.col("source").alias("s0_"), F.col("resolved").alias("t0_")).distinct()
    mine = (move["b"] == e["t0_"]) if own else F.lit(True)
    out, into = move.join(e, (move["a"] == e["s0_"]) & mine), move.where(F.lit(not own)).join(e, (move["a"] == e["t0_"]) & (e["s0_"] != e["t0_"]))
    out = out.withColumns({"s_": F.col("target"), "t_": F.when(F.col("t0_") == F.col("a"), F.col("target")).otherwise(F.col("t0_"))})
    into = into.withColumns({"s_": F.col("s0_"), "t_": F.col("target")})
    new = lambda df, s, t: df.withColumns({"s_": F.col(s), "t_": F.col(t), "s0_": F.col(s), "t0_": F.col(t)})
    return out.unionByName(into).withColumn("real_", F.lit(True)).unionByName(new(port, "a", "target").unionByName(new(port, "b", "target")).unionByName(new(turn, "b", "a")).withColumn("real_", F.lit(False)))


def _judge_together(g: Graph, rules: RuleSet, plans: DataFrame, base: DataFrame) -> DataFrame:
    """The legal plans, for rules that look at single edges alone: what the edge to change forbids is left out before a module's other edges are judged."""
    left = materialize(_legal(g, rules, plans, base, True), "plans")
    return left.where("plan != 'move'").unionByName(_legal(g, rules, left.where("plan = 'move'"), base, False))


def _legal(g: Graph, rules: RuleSet, plans: DataFrame, base: DataFrame, own: bool) -> DataFrame:
    """The plans of which no edge that they add is forbidden; with ``own`` see ``_added``."""
    keys = ["from", "to", "rule", "plan", "target"]
    added = materialize(_added(g, plans, own), "added")
    made = plans.where("plan != 'invert'").select(F.col("target").alias("source")).distinct().withColumns({"coreModule": F.lit(False), "couldNotResolve": F.lit(False), "followable": F.lit(True)})
    known = g.with_(modules=g.modules.unionByName(complete(made, MODULE_COLUMNS), allowMissingColumns=True))
    guess = candidate_edges(added.select(F.col("s_").alias("from"), F.col("t_").alias("to")), known)
    told = _broken(guess, rules).select(F.col("source").alias("s_"), F.col("resolved").alias("t_"), F.col("rule.name").alias("r_"), F.col("rule.severity").alias("sev_"))
    blocked = added.join(told, ["s_", "t_"])
    # an edge that moves keeps what is known of it
    old = added.where("real_").join(g.edges, (F.col("s0_") == g.edges["source"]) & (F.col("t0_") == g.edges["resolved"]))
    old = old.withColumn("module", F.when(F.col("t0_") == F.col("a"), F.col("target")).otherwise(F.col("module"))).withColumn("source", F.col("s_")).withColumn("resolved", F.col("t_")).withColumnRenamed("rule", "rule_of_")
    seen = _broken(old, rules).select("from", "to", F.col("rule_of_").alias("rule"), "plan", "target", "s0_", "t0_", F.col("rule.name").alias("r_"), F.col("rule.severity").alias("sev_"))
    seen = seen.unionByName(blocked.where("not real_").select(seen.columns)).where("sev_ != 'ignore'")
    had = base.select(F.col("f_").alias("s0_"), F.col("t_").alias("t0_"), "r_", F.lit(True).alias("had_")).distinct()
    same = (F.col("r_") == F.col("rule")) & (F.col("s0_") == F.col("from")) & (F.col("t0_") == F.col("to"))
    new = F.col("had_").isNull() & ((F.col("sev_") == "error") | (F.col("r_") == F.col("rule")))
    bad = blocked.where("sev_ = 'error'").select(*keys).unionByName(seen.join(had, ["s0_", "t0_", "r_"], "left").where(same | new).select(*keys))
    return plans.join(bad.distinct(), keys, "left_anti")


def _broken(edges: DataFrame, rules: RuleSet) -> DataFrame:
    own = [(i, r, edge_predicate(r)) for i, r in enumerate(rules.forbidden)]
    return verdicts(edges.withColumn("from_instability", F.lit(None).cast("double")), own, [edge_predicate(r) for r in rules.allowed], rules.allowed_severity)


def _judge_alone(g: Graph, rules: RuleSet, plans: DataFrame, base: DataFrame) -> DataFrame:
    """The first legal plan of each violation and kind, by evaluating the graph of each."""
    had = {tuple(r) for r in base.select("r_", "type", "f_", "t_").collect()}
    done: dict[tuple, object] = {}
    for p in plans.orderBy("from", "to", "rule", "plan", "away", "deep", "target").collect():
        key = (p["from"], p["to"], p["rule"], p["plan"])
        if key in done:
            continue
        lit = {k: F.lit(p[k]) for k in ("a", "b", "target")}
        e, m = g.edges.drop("circular", "cycle", "instability"), g.modules
        if p["plan"] == "move":
            to = lambda c: F.when(F.col(c) == lit["a"], lit["target"]).otherwise(F.col(c))  # noqa: E731, B023
            e = e.withColumn("module", F.when(F.col("resolved") == lit["a"], lit["target"]).otherwise(F.col("module"))).withColumns({"source": to("source"), "resolved": to("resolved")})
            m = m.withColumn("source", to("source"))
        else:
            e = e.where(~((F.col("source") == lit["a"]) & (F.col("resolved") == lit["b"])))
        if p["plan"] == "port":
            m = m.unionByName(complete(g.modules.sparkSession.createDataFrame([(p["target"], p["la_"], False, False, True)], "source string, language string, coreModule boolean, couldNotResolve boolean, followable boolean"), MODULE_COLUMNS), allowMissingColumns=True)
        added = _added(g, plans.where(F.struct("from", "to", "rule", "plan", "target") == F.struct(*[F.lit(p[k]) for k in ("from", "to", "rule", "plan", "target")]))).select(F.col("s_").alias("from"), F.col("t_").alias("to")).distinct()
        trial = Graph(m, complete(e, EDGE_COLUMNS))
        if p["plan"] != "move":
            there = e.select(F.col("source").alias("from"), F.col("resolved").alias("to"))
            trial = trial.with_(edges=trial.edges.unionByName(candidate_edges(added.join(there, ["from", "to"], "left_anti"), trial), allowMissingColumns=True))
        trial = trial.saved()
        # can_import judges by what the rules ask of the whole graph
        if not can_import(metrics.with_metrics(trial) if "metrics" in needs(rules) else trial, rules, added).where("not allowed").isEmpty():
            continue
        name = lambda x: p["a"] if p["plan"] == "move" and x == p["target"] else x  # noqa: E731, B023
        bad = False
        for x in evaluate(trial, rules).violations.where("severity != 'ignore'").select("rule", "type", "from", "to", "severity").collect():
            k = (x["rule"], x["type"], name(x["from"]), name(x["to"]))
            bad |= (k[0], k[2], k[3]) == (p["rule"], p["from"], p["to"]) or k not in had and (x["severity"] == "error" or x["rule"] == p["rule"])
        if not bad:
            done[key] = p
    return g.modules.sparkSession.createDataFrame(list(done.values()), plans.schema)


def diff_edges(old: Graph, new: Graph) -> DataFrame:
    """(from, to, line, change) of edges added and removed, with the first position of each (Q11, Q12)."""

    def first(g: Graph) -> DataFrame:
        return g.edges.groupBy(F.col("source").alias("from"), F.col("resolved").alias("to")).agg(F.min_by("line", "ord").alias("line"))

    a, b = first(old), first(new)
    return b.join(a, ["from", "to"], "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, ["from", "to"], "left_anti").withColumn("change", F.lit("removed")))


def diff_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings that are new or resolved, by id (Q11, Q29); each id once."""
    once = lambda df: df.where("id is not null").groupBy("id").agg(*[F.min(c).alias(c) for c in ("rule", "severity", "from", "to")])
    a, b = once(old), once(new)
    return b.join(a, "id", "left_anti").withColumn("change", F.lit("new")).unionByName(a.join(b, "id", "left_anti").withColumn("change", F.lit("resolved")))


def layer_of(path: Column, layers: Sequence[str]) -> Column:
    """1-based index of the first layer whose pattern matches (Q15); null for none."""
    out = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(layers))):
        out = F.when(regex.matches(path, p), F.lit(i + 1)).otherwise(out)
    return out


def changelog(added: DataFrame, layers: Mapping[str, Sequence[str]], slices: Mapping[str, object] | None = None) -> DataFrame:
    """(from, to, kind, rule, from_side, to_side): added edges that cross a layer or slice border (Q14, Q15)."""
    from depweave.operators.slices import slice_name

    told = []
    for name, ps in layers.items():
        a, b = layer_of(F.col("from"), ps), layer_of(F.col("to"), ps)
        told.append(F.when(a != b, F.struct(F.lit("layers").alias("kind"), F.lit(name).alias("rule"), a.cast("string").alias("from_side"), b.cast("string").alias("to_side"))))
    for name, s in (slices or {}).items():
        a, b = slice_name(F.col("from"), s), slice_name(F.col("to"), s)
        told.append(F.when(a != b, F.struct(F.lit("slices").alias("kind"), F.lit(name).alias("rule"), a.alias("from_side"), b.alias("to_side"))))
    return added.select("from", "to", F.explode(F.array_compact(F.array(*told))).alias("x")).select("from", "to", "x.*")


def snapshot(r: Result, version: str) -> DataFrame:
    """One row per figure at a release: (version, section, name, value) (A17, K25, Q13). Write it partitioned by version."""
    g = metrics.with_metrics(r.graph)
    t = metrics.totals(g)
    row = lambda df, section, name, value: df.select(F.lit(version).alias("version"), F.lit(section).alias("section"), name.alias("name"), value.cast("double").alias("value"))
    one = lambda df, section: row(df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("n"), F.col(c).cast("double").alias("v")) for c in df.columns])).alias("x")), section, F.col("x.n"), F.col("x.v"))
    parts = [
        one(t, "totals"), one(severity_counts(r.violations), "violations"), row(metrics.folder_table(g), "instability", F.col("name"), F.col("instability")),
        row(metrics.project_table(g)[0], "projectInstability", F.col("name"), F.col("instability")),
        row(r.violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n")), "ruleViolations", F.col("rule"), F.col("n")),
        row(rule_counts(g, r.rules), "fromMatches", F.col("rule"), F.col("fromMatches")), row(rule_counts(g, r.rules), "toMatches", F.col("rule"), F.col("toMatches")),
        row(ratchet_counts(g, r.rules.ratchets), "ratchets", F.col("name"), F.col("count")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unused_rules(snapshots: DataFrame, last: int) -> DataFrame:
    """(rule): no match on either side in each of the last ``last`` versions, by version order (Q17, trap 19)."""
    versions = sort_versions([r[0] for r in snapshots.select("version").distinct().collect()])[-last:]
    s = snapshots.where(F.col("section").isin("fromMatches", "toMatches") & F.col("version").isin(versions))
    per = s.groupBy(F.col("name").alias("rule")).agg(F.max("value").alias("most"), F.count_distinct("version").alias("n"))
    return per.where((F.col("most") == 0) & (F.col("n") == len(versions))).select("rule")


def retired_rules(snapshots: DataFrame, since: str, to: str, rules: RuleSet) -> list[tuple[str, bool]]:
    """(rule, removed): gone between two versions, or deprecated in between (Q16)."""
    names = lambda v: {r[0] for r in snapshots.where((F.col("version") == v) & (F.col("section") == "fromMatches")).select("name").collect()}
    out = {n: True for n in names(since) - names(to)}
    for r in rules.all():
        if r.deprecated and precedence(r.deprecated, since) > 0 and precedence(r.deprecated, to) <= 0:
            out.setdefault(r.name, False)
    return sorted(out.items())


def fallen_ratchets(snapshots: DataFrame, since: str, to: str) -> DataFrame:
    """(name, before, after) of ratchets that went down (Q16)."""
    at = lambda v, n: snapshots.where((F.col("version") == v) & (F.col("section") == "ratchets")).select("name", F.col("value").alias(n))
    return at(since, "before").join(at(to, "after"), "name").where("after < before")


def explain(g: Graph, r: Rule) -> tuple[str, DataFrame]:
    """A rule in a sentence, and its first ten edges in order (Q18, Q19)."""
    from depweave.plans.compile import edge_predicate

    e = g.edges.withColumn("from_instability", F.lit(None).cast("double")).where(edge_predicate(r))
    return sentence(r), e.orderBy("source", "ord").select("source", "resolved").limit(10)


def sentence(r: Rule) -> str:
    """Plain words for a rule."""
    side = lambda p, n, every: (f"matching {p}" if p else every) + (f" but not {n}" if n else "")
    if r.from_.orphan is not None:
        return f"No module {side(r.from_.path, r.from_.pathNot, 'at all')} may be {'an orphan' if r.from_.orphan else 'connected'}."
    if r.module is not None and r.to.path:
        return f"Every module {side(r.module.path, r.module.pathNot, 'at all')} must depend on one matching {r.to.path}."
    if r.module is not None:
        few, many = r.module.numberOfDependentsLessThan, r.module.numberOfDependentsMoreThan
        return f"A module {side(r.module.path, r.module.pathNot, 'at all')} must have {f'at least {few}' if few else ''}{' and ' if few and many else ''}{f'at most {many}' if many else ''} dependents."
    verb = {True: "reach", False: "be out of reach of", None: "depend on"}[r.to.reachable]
    extra = [n for n, v in (("in a cycle", r.to.circular), ("that is less stable", r.to.moreUnstable), ("through a dynamic import", r.to.dynamic), ("that cannot be resolved", r.to.couldNotResolve)) if v]
    types = f" by {' or '.join(r.to.dependencyTypes)}" if r.to.dependencyTypes else ""
    return f"No module {side(r.from_.path, r.from_.pathNot, 'at all')} may {verb} a module {side(r.to.path, r.to.pathNot, 'at all')}{types}{''.join(' ' + e for e in extra)}."


def run_examples(spark, rules: RuleSet) -> DataFrame:
    """(rule, edge, wanted, passed): the rules' own examples on a graph made of them (Q20)."""
    rows = []
    for r in rules.forbidden:
        for want, key in ((True, "forbidden"), (False, "allowed")):
            for x in r.examples.get(key, ()):
                a, b = (s.strip() for s in x.split("->"))
                rows.append((r.name, x, a, b, want))
    ex = spark.createDataFrame(rows, "rule string, edge string, `from` string, `to` string, wanted boolean")
    g = Graph.of(ex.select(F.col("from").alias("source"), F.col("to").alias("resolved"), F.lit(0).cast("bigint").alias("ord"), F.array(F.lit("local")).alias("dependencyTypes")).distinct())
    v = evaluate(g, rules).violations.select("rule", "from", "to").distinct().withColumn("fired", F.lit(True))
    return ex.join(v, ["rule", "from", "to"], "left").select("rule", "edge", "wanted", (F.coalesce("fired", F.lit(False)) == F.col("wanted")).alias("passed"))


def prefix(g: Graph, name: str | Column) -> Graph:
    """Paths below a repository's name, or below that in a column of both tables; core and unresolved names stay."""
    keep = F.coalesce("coreModule", F.lit(False)) | F.coalesce("couldNotResolve", F.lit(False))
    under = lambda c: F.concat(F.lit(name) if isinstance(name, str) else name, F.lit("/"), c)
    m = g.modules.withColumn("source", F.when(keep, F.col("source")).otherwise(under(F.col("source"))))
    e = g.edges.withColumn("resolved", F.when(keep, F.col("resolved")).otherwise(under(F.col("resolved")))).withColumn("source", under(F.col("source")))
    if "cycle" in e.columns:
        e = e.withColumn("cycle", F.transform("cycle", lambda s: F.struct(under(s["name"]).alias("name"), s["dependencyTypes"].alias("dependencyTypes"))))
    return Graph(m, e)


def fleet(repos: Mapping[str, Graph]) -> Graph:
    """One graph of many repositories: prefixed, the first repository's module wins."""
    parts = [(i, prefix(g, n)) for i, (n, g) in enumerate(repos.items())]
    modules = edges = None
    for i, g in parts:
        m, e = g.modules.withColumn("repo_", F.lit(i)), g.edges
        modules = m if modules is None else modules.unionByName(m, allowMissingColumns=True)
        edges = e if edges is None else edges.unionByName(e, allowMissingColumns=True)
    first = modules.groupBy("source").agg(F.min_by(F.struct(*[c for c in modules.columns if c != "repo_"]), "repo_").alias("m_")).select("m_.*")
    return Graph(first, edges)


def fleet_table(edges: DataFrame, repo: str = "repo") -> Graph:
    """``fleet`` of an edge table with a column of repository names: all of them in one pass, however many there are.

    Of a module that several repositories name, the first one's in byte order of their names wins.
    """
    g = Graph.of(edges)
    flags = ("coreModule", "couldNotResolve", "matchesDoNotFollow")
    ends = g.edges.select(repo, "source", *[F.lit(False).alias(c) for c in flags]).unionByName(g.edges.select(repo, F.col("resolved").alias("source"), *flags))
    modules = ends.groupBy(repo, "source").agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in flags])
    under = prefix(Graph(modules, g.edges), F.col(repo))
    first = under.modules.groupBy("source").agg(F.min_by(F.struct(*flags), repo).alias("m_")).select("source", "m_.*")
    return Graph(complete(first, MODULE_COLUMNS), under.edges)


def fleet_findings(own: Mapping[str, DataFrame], fleet_wide: DataFrame) -> DataFrame:
    """Findings of the fleet's rules and of each repository's own, the latter's ends prefixed (Q23)."""
    out = fleet_wide.withColumn("repo", F.lit(None).cast("string"))
    for n, v in own.items():
        put = lambda c: F.concat(F.lit(n + "/"), F.col(c))  # noqa: E731, B023
        out = out.unionByName(v.withColumn("from", put("from")).withColumn("to", put("to")).withColumn("repo", F.lit(n)), allowMissingColumns=True)
    return out


def affected(g: Graph, changes: DataFrame, depth: int = 0) -> DataFrame:
    """(source, level): changed modules and everything that depends on them, to a depth.

    ``changes`` is (path, kind, old_path); a deleted or renamed file counts
    through the modules that still import its old name.
    """
    names = changes.select(F.explode(F.array_compact(F.array("path", "old_path"))).alias("node")).distinct()
    present = names.join(g.modules.select(F.col("source").alias("node")), "node", "left_semi")
    gone = names.join(g.modules.select(F.col("source").alias("node")), "node", "left_anti")
    importers = g.edges.join(gone.withColumnRenamed("node", "resolved"), "resolved", "left_semi").select(F.col("source").alias("node"))
    return reach_set(g.pairs, present.unionByName(importers).distinct(), depth, reverse=True).select(F.col("node").alias("source"), "level")


def touching(v: DataFrame, closure: DataFrame) -> DataFrame:
    """Findings that touch a set of modules (source), by their type (Q24, Q25): ends, steps of the cycle or path, or the folder that holds one."""
    n = v.withColumn("v_", F.xxhash64(F.to_json(F.struct(*v.columns))))
    steps = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(f"{dict(v.dtypes)[c]}")), lambda s: s["name"])
    none = F.array().cast("array<string>")
    ends = F.array_compact(F.when(F.col("type").isin("reachability", "element"), F.array("from", "to")).otherwise(F.array("from")))
    names = F.concat(ends, F.when(F.col("type") == "cycle", steps("cycle")).otherwise(none), F.when(F.col("type") == "reachability", steps("via")).otherwise(none))
    # a folder is touched through any of its modules: their parent folders are the names to meet
    folders = closure.select(F.explode(parents(dirname(F.col("source")))).alias("name"))
    by_name = n.where("type != 'folder'").select("v_", F.explode(names).alias("name")).join(closure.select(F.col("source").alias("name")).distinct(), "name", "left_semi")
    by_folder = n.where("type = 'folder'").select("v_", F.col("from").alias("name")).join(folders.distinct(), "name", "left_semi")
    return n.join(by_name.select("v_").unionByName(by_folder.select("v_")).distinct(), "v_", "left_semi").drop("v_")


def brief(r: Result, today: date | None = None) -> DataFrame:
    """(section, name, state, n): open findings by rule, ratchets with headroom or excess, rules that match nothing, expired rules (Q26)."""
    spark = r.violations.sparkSession
    told = r.violations.where("severity != 'ignore'").groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n")).select(F.lit("open").alias("section"), F.col("rule").alias("name"), F.col("severity").alias("state"), "n")
    ratchets = ratchet_counts(r.graph, r.rules.ratchets).select(F.lit("ratchet"), "name", "verdict", "by")
    more = [("vacuous", n, None, None) for n in vacuous(r.graph, r.rules)] + [("expired", n, None, None) for n in (expired(r.rules, today) if today else ())]
    return told.union(ratchets).union(spark.createDataFrame(more, "section string, name string, state string, n bigint"))


def lint_graph(g: Graph, rules: RuleSet, violations: DataFrame) -> DataFrame:
    """(rule, finding): rules that match nothing, and rules below error without a finding (Q22, Q30)."""
    counts = rule_counts(g, rules)
    fired = violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    sev = g.modules.sparkSession.createDataFrame([(r.name, r.severity) for r in rules.all()] or [("", "")], "rule string, severity string")
    j = counts.join(sev, "rule").join(fired, "rule", "left")
    told = F.array_compact(F.array(F.when(F.col("fromMatches") == 0, F.lit("never-matches")), F.when((F.col("severity") != "error") & F.col("n").isNull(), F.lit("severity-below-error"))))
    return j.select("rule", F.explode(told).alias("finding")).distinct()
