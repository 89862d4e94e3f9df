"""The N best items of every group.

A mergeable aggregation: each task keeps a heap of at most N entries per
group before the shuffle, heaps are merged after it. The heap is Spark's own
bounded priority queue (the aggregate behind top-k recommendations), so rows
never leave the JVM and no group is ever collected or sorted whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.session import fresh


def bounded_heap(entry: Column, n: int) -> Column:
    """Aggregate: the ``n`` smallest values of ``entry`` as an array in ascending order."""
    if n < 1:
        raise ValueError("n must be at least 1")
    from pyspark import SparkContext

    jvm = SparkContext._active_spark_context._jvm
    module = getattr(getattr(jvm.org.apache.spark.sql, "Column$"), "MODULE$")
    args = jvm.PythonUtils.toSeq([entry._jc, F.lit(n)._jc, F.lit(True)._jc])
    return Column(module.internalFn("collect_top_k", args))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per key: the columns ``keep`` of the row that is last by ``order``.

    Null comes before every value; rows equal in ``order`` are decided by
    ``keep`` itself, so the result is the same on every run. Partial
    aggregation runs before the shuffle, so a key delivered a million times
    costs one row per task.
    """
    best = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])).alias("best_")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"best_.k{i}").alias(c) for i, c in enumerate(keep)])


def top_n(df: DataFrame, group: Sequence[str], score: str, item: str, n: int, rank: str = "rank") -> DataFrame:
    """The ``n`` rows of highest integer ``score`` in every group, equal scores in ascending byte order of ``item``.

    Returns (group..., item, score, rank from 1). Rows with a null score are
    left out; a null item comes before all others; a null in the group is a
    value of its own; an item that repeats in a group takes a place each
    time (use ``latest`` first to have it once); an empty table gives no rows.
    """
    group = list(group)
    rank = fresh(rank, group, [item, score])
    # the bitwise complement turns descending scores into ascending ones without overflow
    entry = F.struct(F.bitwise_not(F.col(score)).alias("s"), F.col(item).alias("i"))
    heaps = df.where(F.col(score).isNotNull()).groupBy(*group).agg(bounded_heap(entry, n).alias("heap_"))
    return heaps.select(*group, F.posexplode("heap_").alias("p_", "e_")).select(
        *group, F.col("e_.i").alias(item), F.bitwise_not(F.col("e_.s")).alias(score), (F.col("p_") + 1).alias(rank)
    )
