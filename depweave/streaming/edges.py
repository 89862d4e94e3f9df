"""Edges that arrive over time (T1-T7, T9): a re-check per batch, and windows over edge events.

Batches are judged edge by edge, with what a stored graph says about the ends;
rules that a batch can't judge have to be named. The event-time operators are
extensions of this engine.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depweave.operators.evaluate import dependency_violations
from depweave.operators.graph import EDGE_COLUMNS, Graph, complete
from depweave.operators.metrics import with_metrics
from depweave.plans.compile import needs
from depweave.plans.rules import RuleSet
from depweave.session import materialize, shared_dir


def changed_inputs(now: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, change) of files whose fingerprint differs from the cached manifest (T1); both are (path, fingerprint)."""
    j = now.select("path", F.col("fingerprint").alias("a")).join(cached.select("path", F.col("fingerprint").alias("b")), "path", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return j.select("path", change.alias("change")).where("change is not null")


def cache_key(config: str, inputs: DataFrame) -> str:
    """Key of an evaluated result (T2-T4): the configuration and an order-free digest of its inputs."""
    import hashlib

    from depweave.sinks.reports import table_digest

    return hashlib.sha256(f"{config}\n{inputs.agg(table_digest(inputs)).first()[0]}".encode()).hexdigest()


def cached(spark: SparkSession, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The saved table of a key, made once."""
    path = f"{shared_dir(spark)}/results/{key}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def unjudged(rules: RuleSet, stored: bool) -> list[tuple[str, str]]:
    """(name, reason) of the rules and ratchets that edges of a batch can't answer, with or without a stored graph."""
    out = []
    for r in rules.all():
        if r.family != "dependency" or r in rules.required:
            out.append((r.name, "looks at modules, folders or projects of the whole graph"))
        elif r.to.circular is not None or r.to.via is not None or r.to.viaOnly is not None:
            out.append((r.name, "needs the cycles of the whole graph"))
        elif not stored and (r.to.moreUnstable is not None or r.from_.cross.given() or r.to.cross.given()):
            out.append((r.name, "needs a stored graph's facts about modules"))
    return out + [(r.name, "counts edges of the whole graph") for r in rules.ratchets]


def watch(edges: DataFrame, rules: RuleSet, sink: str, checkpoint: str, once: bool = True, stored: Graph | None = None, left_out: Collection[str] = ()) -> StreamingQuery:
    """Judge edges as they arrive (T7): each micro-batch's edges go through the rules that look at single edges.

    An edge that comes again unchanged within a batch is judged once; edges of
    one pair that differ in anything else than their delivery are judged each.
    Facts about both ends (language, project, namespaces, assemblies,
    instability) are those of ``stored``; a module it does not hold has none.

    Rules that a batch can't judge (``unjudged``) are refused unless
    ``left_out`` names them: they are left to a full run. If one of them is an
    ``allowed`` rule, no edge is told not to be allowed.
    """
    cant = unjudged(rules, stored is not None)
    refused = [f"{n}: {why}" for n, why in cant if n not in left_out]
    if refused:
        raise ValueError("a batch can't judge " + "; ".join(refused))
    names = {n for n, _ in cant}
    whole = not any(r.name in names for r in rules.allowed)
    mine = replace(rules, forbidden=tuple(r for r in rules.forbidden if r.name not in names), allowed=rules.allowed if whole else (), required=(), ratchets=())
    facts = None
    if stored is not None and needs(mine) & {"facts", "metrics"}:
        modules = with_metrics(stored).modules if "metrics" in needs(mine) else stored.modules
        facts = materialize(modules, "stored-modules")

    def check(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        g = Graph.of(batch.dropDuplicates([c for c in batch.columns if c in EDGE_COLUMNS]))
        if facts is not None:
            about = facts.select(F.col("source").alias("resolved"), F.col("instability").alias("stored_"))
            e = g.edges.join(about, "resolved", "left").withColumn("instability", F.coalesce("stored_", "instability")).drop("stored_")
            g = Graph(facts, complete(e, EDGE_COLUMNS))
        dependency_violations(g, mine).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    w = edges.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def edge_windows(edges: DataFrame, time: str, key: str, lateness: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, end, key, edges): edges per window of event time; rows later than the watermark are dropped. For streams and tables."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = edges.withWatermark(time, lateness).groupBy(w.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("edges"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "edges")


def sessions(edges: DataFrame, time: str, key: str, gap: str, lateness: str = "1 hour") -> DataFrame:
    """(start, end, key, edges): runs of edges of one key without a pause longer than ``gap``."""
    w = F.session_window(time, gap)
    out = edges.withWatermark(time, lateness).groupBy(w.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("edges"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "edges")


def first_deliveries(edges: DataFrame, time: str, identity: list[str], lateness: str = "7 days") -> DataFrame:
    """Edges without redeliveries, on a stream: state is kept only as long as the watermark needs it."""
    return edges.withWatermark(time, lateness).dropDuplicatesWithinWatermark(identity)
