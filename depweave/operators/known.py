"""Known findings and ratchets: semi, anti and outer joins over violation tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.functions.regex import captured
from depweave.operators.evaluate import VIOLATION, identity_key
from depweave.operators.graph import Graph, complete
from depweave.plans.compile import all_of, cross, kinds, path_pair
from depweave.plans.rules import Ratchet, RuleSet

KNOWN = {**VIOLATION, "id": "string", "expires": "date", "owner": "string", "reason": "string"}
EDGE_TYPES = ("dependency", "cycle", "instability")
MODULE_TYPES = ("module", "reachability")
OBJECT_TYPES = ("element", "slice")


def known_set(known: DataFrame, today: date) -> DataFrame:
    """Entries with a number and whether they are still honoured: through their last day (B1, trap 16)."""
    k = complete(known, KNOWN)
    honoured = F.col("expires").isNull() | (F.lit(today) <= F.col("expires"))
    key = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("type", "rule", "from", "to", "id")], F.to_json(F.struct("cycle", "via")).alias("x"))
    return k.withColumn("entry", F.xxhash64(key)).withColumn("honoured", honoured)


def expired_entries(known: DataFrame, today: date) -> DataFrame:
    """Entries past their last day, by the name they are shown under."""
    k = known_set(known, today).where("not honoured")
    return k.select(F.coalesce("id", F.concat_ws(" -> ", F.coalesce("from", F.lit("?")), F.coalesce("to", F.lit("?")))).alias("name"), "expires")


def matches(v: DataFrame, known: DataFrame) -> DataFrame:
    """(v_id_, entry, honoured): which entry matches which finding (B2, B3, A.8).

    Equi-joins only: by id; module entries by rule and importer; edge entries
    by what makes two findings the same; element and slice entries by rule
    and the ends they name. ``v`` has a number in ``v_id_``.
    """
    key = F.to_json(identity_key(v))
    e, m, o = F.col("type").isin(*EDGE_TYPES), F.col("type").isin(*MODULE_TYPES), F.col("type").isin(*OBJECT_TYPES)
    out = v.where("id is not null").select("v_id_", "id").join(known.where("id is not null").select("id", "entry", "honoured"), "id").select("v_id_", "entry", "honoured")
    edge = v.where(e).select("v_id_", key.alias("k")).join(known.where(e).select(F.to_json(identity_key(known)).alias("k"), "entry", "honoured"), "k")
    mod = v.where(m).select("v_id_", "rule", "from").join(known.where(m).select("rule", "from", "entry", "honoured"), ["rule", "from"])
    parts = [out, edge.select("v_id_", "entry", "honoured"), mod.select("v_id_", "entry", "honoured")]
    for on, given in ((["from", "to"], "`from` is not null and `to` is not null"), (["from"], "`from` is not null and `to` is null"), (["to"], "`from` is null and `to` is not null")):
        cols = ["type", "rule", *on]
        parts.append(v.where(o).select("v_id_", *cols).join(known.where(o).where(given).select(*cols, "entry", "honoured"), cols).select("v_id_", "entry", "honoured"))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.distinct()


def _numbered(v: DataFrame) -> DataFrame:
    """A number per finding that depends on its content alone."""
    return v.withColumn("v_id_", F.xxhash64(F.to_json(F.struct(*[c for c in v.columns]))))


def soften(v: DataFrame, known: DataFrame, today: date) -> DataFrame:
    """Findings with severity ``ignore`` where an honoured entry matches."""
    n = _numbered(v)
    hit = matches(n, known_set(known, today)).where("honoured").select("v_id_").distinct().withColumn("hit_", F.lit(True))
    return n.join(hit, "v_id_", "left").withColumn("severity", F.when(F.col("hit_"), "ignore").otherwise(F.col("severity"))).drop("v_id_", "hit_")


def stale(v: DataFrame, known: DataFrame, today: date) -> DataFrame:
    """Entries no finding matches."""
    k = known_set(known, today)
    return k.join(matches(_numbered(v), k).select("entry").distinct(), "entry", "left_anti").drop("entry")


def observed(v: DataFrame, known: DataFrame, today: date) -> DataFrame:
    """Entries some finding matches, expired ones included."""
    k = known_set(known, today)
    return k.join(matches(_numbered(v), k).select("entry").distinct(), "entry", "left_semi").drop("entry")


def baseline(v: DataFrame, known: DataFrame | None, today: date, mode: str = "full") -> DataFrame:
    """Entries to write (B8, B9, B14): all findings (``full``), those known already (``shrink-only``), or the file's own (``format``). Lifecycle is carried over by id."""
    if mode == "format":
        return complete(known, KNOWN)
    new = complete(v, {k: t for k, t in KNOWN.items() if k not in ("expires", "owner", "reason")})
    if known is None:
        return complete(new, KNOWN)
    if mode == "shrink-only":
        n = _numbered(v)
        still = n.join(matches(n, known_set(known, today)).select("v_id_").distinct(), "v_id_", "left_semi").drop("v_id_")
        new = complete(still, {k: t for k, t in KNOWN.items() if k not in ("expires", "owner", "reason")})
    life = complete(known, KNOWN).where("id is not null").groupBy("id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("expires", "owner", "reason")])
    return complete(new.drop("expires", "owner", "reason").join(life, "id", "left"), KNOWN).select(*KNOWN)


def full_key(df: DataFrame) -> Column:
    """Everything but the severity."""
    arr = lambda c: F.to_json(F.struct(F.col(c)))
    return F.concat_ws("\x01", *[F.coalesce(F.col(c), F.lit("")) for c in ("rule", "from", "to", "unresolvedTo", "type")], *[arr(c) for c in ("dependencyTypes", "cycle", "via")])


def diff_violations(first: DataFrame, second: DataFrame) -> DataFrame:
    """Findings with ``state`` old, same or new; equal findings pair one to one whatever their severity."""

    def numbered(df: DataFrame, side: str) -> DataFrame:
        # repeats are counted map-side; only their number travels
        c = complete(df, VIOLATION)
        return c.withColumn("k_", full_key(c)).groupBy("k_").agg(F.count(F.lit(1)).alias("n_" + side), F.min_by(F.struct(*VIOLATION), F.col("severity")).alias("v_" + side))

    j = numbered(first, "a").join(numbered(second, "b"), "k_", "full")
    a, b = F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))
    state = lambda s, n: F.struct(F.lit(s).alias("state"), n.cast("bigint").alias("n"))
    rows = F.array(state("same", F.least(a, b)), state("old", F.greatest(a - b, F.lit(0))), state("new", F.greatest(b - a, F.lit(0))))
    out = j.select(F.coalesce("v_a", "v_b").alias("v_"), F.explode(F.filter(rows, lambda r: r["n"] > 0)).alias("s_"))
    return out.select("v_.*", "s_.state", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("s_.n"))).alias("x_")).drop("x_")


def restore_severities(v: DataFrame, rules: RuleSet) -> DataFrame:
    """Softened findings with their rule's severity again."""
    own = {r.name: r.severity for r in rules.all()}
    if rules.allowed_severity:
        own["not-in-allowed"] = rules.allowed_severity
    if not own:
        return v
    m = F.element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), F.col("rule"))
    return v.withColumn("severity", F.when(F.col("severity") == "ignore", F.coalesce(m, F.col("severity"))).otherwise(F.col("severity")))


def ratchet_predicate(r: Ratchet) -> Column:
    """The edges a ratchet counts: paths with captures, kinds and cross-language keys; other keys play no part (A12, trap 17)."""
    found = captured(F.col("source"), r.from_.path) if r.from_.path else None
    return all_of([
        path_pair(F.col("source"), r.from_.path, r.from_.pathNot), path_pair(F.col("resolved"), r.to.path, r.to.pathNot, found), kinds(r.to),
        cross(r.from_.cross, "from_") if r.from_.cross.given() else None, cross(r.to.cross, "to_") if r.to.cross.given() else None,
    ])


def ratchet_counts(g: Graph, ratchets: Sequence[Ratchet], budgets: dict[str, int] | None = None) -> DataFrame:
    """(name, count, ceiling, verdict, by) of all ratchets from one scan (B12, B13): unbudgeted, within (headroom) or over (excess)."""
    from depweave.operators.evaluate import with_facts

    spark = g.edges.sparkSession
    schema = "name string, count bigint, ceiling bigint, verdict string, by bigint"
    if not ratchets:
        return spark.createDataFrame([], schema)
    df = with_facts(g) if any(r.from_.cross.given() or r.to.cross.given() for r in ratchets) else g.edges
    counts = df.agg(*[F.count_if(ratchet_predicate(r)).alias(f"r{i}") for i, r in enumerate(ratchets)]).first()
    rows = []
    for i, r in enumerate(ratchets):
        top = (budgets or {}).get(r.name, r.max)
        n = counts[f"r{i}"]
        rows.append((r.name, n, top, "unbudgeted", None) if top is None else (r.name, n, top, "over", n - top) if n > top else (r.name, n, top, "within", top - n))
    return spark.createDataFrame(rows, schema)


def lower_budget(count: int, ceiling: int | None) -> int:
    """The ceiling to write (K24, Q2): it only falls."""
    if ceiling is not None and count > ceiling:
        raise ValueError(f"the count {count} is above the ceiling {ceiling}; a ratchet only falls")
    return count


def apply_known(v: DataFrame, known: DataFrame, today: date) -> tuple[DataFrame, DataFrame]:
    """Softened findings of a saved document and their counts anew."""
    from depweave.operators.evaluate import severity_counts

    s = soften(v, known, today)
    return s, severity_counts(s)


def one_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key (keep-first), by window; for tables with one row per key and repository."""
    return df.withColumn("n_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("n_ = 1").drop("n_")
