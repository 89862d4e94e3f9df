"""Per-key work when a few keys hold most rows.

Fragment-replicate by estimated load: the load of every key is counted with a
map-side combine, keys are bin-packed to tasks (longest first), a key above a
task's share is split into as many shards as its load is shares, and a
matching side is replicated to just the shards of its key.

Loads are estimated from a sample of the rows; they place rows and change no
result. Sizes: the driver sees at most ``4 * tasks`` heavy keys and the loads of
``32 * tasks`` buckets of light keys; both are bounded by the number of
tasks, not by the data.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.session import fresh, materialize, parallelism

HEAVY_PER_TASK = 4
BUCKETS_PER_TASK = 32
SEED = 7919
#: Share of the rows that loads are estimated from. A key with a quarter of a task's share of a million rows is then estimated within a few percent.
LOAD_SHARE = 1 / 16


@dataclass
class Placement:
    """Where rows go. ``shards``: heavy key -> its shards' tasks, in shard order; ``bucket_task``: light bucket -> task."""

    tasks: int
    key: list[str]
    total: int
    shards: dict[tuple, list[int]]
    bucket_task: list[int]
    planned: list[int]

    def heavy_table(self, df: DataFrame, prefix: str) -> DataFrame:
        """(key..., ``{prefix}tasks`` array) of the heavy keys, at most ``HEAVY_PER_TASK * tasks`` rows."""
        kinds = [df.schema[k].dataType.simpleString() for k in self.key]
        cols = [f"{prefix}k{i}" for i in range(len(self.key))]
        schema = ", ".join(f"{c} {t}" for c, t in zip(cols, kinds)) + f", {prefix}tasks array<int>"
        return df.sparkSession.createDataFrame([(*k, v) for k, v in self.shards.items()], schema)


def bucket_of(cols: Sequence[Column], n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *cols), F.lit(n)).cast("int")


def pack(units: list[tuple[float, object]], tasks: int) -> tuple[dict[object, int], list[float]]:
    """Longest-processing-time bin packing of (load, unit) to tasks."""
    heap = [(0.0, t) for t in range(tasks)]
    at: dict[object, int] = {}
    for load, unit in sorted(units, key=lambda u: (-u[0], str(u[1]))):
        used, t = heapq.heappop(heap)
        at[unit] = t
        heapq.heappush(heap, (used + load, t))
    loads = [0.0] * tasks
    for used, t in heap:
        loads[t] = used
    return at, loads


def plan(loads: DataFrame, key: Sequence[str], load: str, tasks: int) -> Placement:
    """Placement from a table of (key, load), one row per key. Null is a key of its own."""
    key, n = list(key), BUCKETS_PER_TASK * tasks
    total = loads.agg(F.sum(load)).first()[0] or 0
    limit = max(1.0, total / (HEAVY_PER_TASK * tasks))
    heavy = {tuple(r[:-1]): r[-1] for r in loads.where(F.col(load) > limit).select(*key, load).collect()}
    rest = (
        loads.where(F.col(load) <= limit)
        .groupBy(bucket_of([F.col(k) for k in key], n).alias("bucket_"))
        .agg(F.sum(load).alias("load_"))
        .collect()
    )
    share = max(1.0, total / tasks)
    units: list[tuple[float, object]] = [(r[1], ("bucket", r[0])) for r in rest]
    count = {}
    for k, v in heavy.items():
        # shards of a quarter of a share pack evenly beside the light buckets
        count[k] = max(1, -(-int(v * HEAVY_PER_TASK) // int(share)))
        units += [(v / count[k], ("key", k, s)) for s in range(count[k])]
    at, planned = pack(units, tasks)
    return Placement(
        tasks,
        key,
        total,
        {k: [at[("key", k, s)] for s in range(count[k])] for k in heavy},
        [at.get(("bucket", b), b % tasks) for b in range(n)],
        [round(x) for x in planned],
    )


def key_loads(df: DataFrame, key: Sequence[str], load: str = "load_", share: float = 1.0) -> DataFrame:
    """Rows per key, combined before the shuffle, written once to the shared folder.

    With ``share`` below 1 they are estimated from so many of the rows. Loads
    decide where rows go, never what comes out; a key the sample has missed is
    a light one.
    """
    some = df if share >= 1 else df.sample(share, SEED)
    return materialize(some.groupBy(*key).agg(F.count(F.lit(1)).alias(load)), "loads")


def _located(df: DataFrame, placement: Placement, prefix: str) -> DataFrame:
    """Adds ``{prefix}tasks``, the tasks of a heavy key's shards (null for a light key), and ``{prefix}task``, that of a light key's bucket.

    Both tables are broadcast: they hold at most ``HEAVY_PER_TASK`` and
    exactly ``BUCKETS_PER_TASK`` rows a task.
    """
    heavy = placement.heavy_table(df, prefix)
    on = [df[k].eqNullSafe(heavy[f"{prefix}k{i}"]) for i, k in enumerate(placement.key)]
    out = df.join(F.broadcast(heavy), on, "left").drop(*[f"{prefix}k{i}" for i in range(len(placement.key))])
    light = df.sparkSession.createDataFrame(list(enumerate(placement.bucket_task)), f"{prefix}b int, {prefix}task int")
    b = bucket_of([F.col(k) for k in placement.key], len(placement.bucket_task))
    return out.withColumn(f"{prefix}b", b).join(F.broadcast(light), f"{prefix}b", "left").drop(f"{prefix}b")


def fragment(df: DataFrame, placement: Placement, identity: Sequence[str], task: str) -> DataFrame:
    """Move every row to its task. Rows of one heavy key part by ``identity``, so equal identities stay together."""
    p = fresh("shard_", [c[: len("shard_")] for c in df.columns])
    at = F.col(p + "tasks")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in identity]), F.size(at)).cast("int")
    routed = _located(df, placement, p).withColumn(task, F.when(at.isNotNull(), F.element_at(at, spread + 1)).otherwise(F.col(p + "task")))
    return routed.drop(p + "tasks", p + "task").repartitionById(placement.tasks, F.col(task))


def replicate(df: DataFrame, placement: Placement, task: str) -> DataFrame:
    """Copy every row of the matching side to the tasks its key has shards on, and to no other."""
    p = fresh("shard_", [c[: len("shard_")] for c in df.columns])
    at = F.col(p + "tasks")
    copied = _located(df, placement, p).withColumn(task, F.explode(F.when(at.isNotNull(), F.array_distinct(at)).otherwise(F.array(p + "task"))))
    return copied.drop(p + "tasks", p + "task").repartitionById(placement.tasks, F.col(task))


def skew_join(big: DataFrame, small: DataFrame, key: Sequence[str], identity: Sequence[str], tasks: int | None = None, how: str = "inner") -> DataFrame:
    """Join (``inner`` or ``left``) of a side with heavy keys with a matching side.

    ``big`` is fragmented and ``small`` replicated by one placement, so the
    join needs no further exchange and no task gets a whole heavy key. Null
    keys match nothing. Columns of ``small`` whose names ``big`` has already
    come out with a trailing underscore; empty sides give an empty (``left``:
    unmatched) result.
    """
    key = list(key)
    tasks = tasks or parallelism(big.sparkSession)
    placement = plan(key_loads(big, key, share=LOAD_SHARE), key, "load_", tasks)
    task = fresh("task_", big.columns, small.columns)
    left = fragment(big, placement, identity, task)
    names = {}
    for c in small.columns:
        if c not in key:
            names[c] = fresh(c, big.columns, list(names.values()), [task])
    right = replicate(small.select(*key, *[F.col(c).alias(n) for c, n in names.items()]), placement, task)
    return left.join(right, [task, *key], how).drop(task)


def distinct_counts(df: DataFrame, key: Sequence[str], identity: Sequence[str], items: str, tasks: int | None = None) -> DataFrame:
    """Per key and per entry of the array ``items``: the number of distinct ``identity``s.

    Returns (key..., ``item``, ``n``; with an underscore behind where a key has that name). Rows with ``item`` null hold the number
    of identities of a key whatever its items. An identity counts once per
    item however often it is delivered or the item repeated; null items are
    none; null and empty arrays count only in the ``item`` null row. A null
    key is a key of its own. An empty table gives no rows.

    Identities travel as 128-bit hashes and items without repeats and nulls.
    Deduplication and counting run inside the placed tasks without another
    exchange; what is shuffled afterwards is one row per task, key and item.
    """
    key = list(key)
    tasks = tasks or parallelism(df.sparkSession)
    placement = plan(key_loads(df, key, share=LOAD_SHARE), key, "load_", tasks)
    names: list[str] = []
    for base in ("task_", "id1_", "id2_", "items_", "item", "n", "n_"):
        names.append(fresh(base, key, names))
    task, a, b, some, item, n, part_n = names
    told = [x for c in identity for x in (F.col(c).isNull(), F.col(c))]
    slim = df.select(*key, F.xxhash64(F.lit(1), *told).alias(a), F.xxhash64(F.lit(2), *told).alias(b), _items(items).alias(some))
    rows = fragment(slim, placement, [a, b], task)
    once = rows.select(task, *key, a, b, F.explode(some).alias(item)).distinct()
    part = once.groupBy(task, *key, item).agg(F.count(F.lit(1)).alias(part_n))
    return part.groupBy(*key, item).agg(F.sum(part_n).alias(n))


def _items(items: str) -> Column:
    """The entries of a list once each, and a null for the row itself."""
    some = F.coalesce(F.array_distinct(F.array_compact(F.col(items))), F.array().cast("array<string>"))
    return F.concat(some, F.array(F.lit(None).cast("string")))
