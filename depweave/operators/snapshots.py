"""What changed between consecutive full snapshots of keyed tables.

Rows are sorted by (group, snapshot, key) over range partitions and cut
into content-defined chunks: a row whose key hash hits a mask opens a chunk,
so a chunk's borders depend on the keys alone and survive insertions elsewhere.
Chunks of equal digest in two consecutive snapshots hold the same rows and are
discarded; only rows of the remaining chunks are joined and classified.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.session import materialize, parallelism

MEAN_CHUNK = 32


def cut_chunks(rows: DataFrame, mask: int) -> DataFrame:
    """Adds ``chunk``: an id that rows of one chunk share. ``rows`` has group_, snap_, key_hash_ and is sorted within its partitions.

    A chunk also ends with its partition; the pieces then differ from the
    other snapshot's chunk and are compared by rows, which costs a little and
    changes no result.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", chunk long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            snap = batch.column("snap_hash_").to_numpy(zero_copy_only=False)
            opens = (batch.column("key_hash_").to_numpy(zero_copy_only=False) & mask) == 0
            turn = np.empty(len(snap), bool)
            turn[0] = last is None or snap[0] != last
            turn[1:] = snap[1:] != snap[:-1]
            ids = count + np.cumsum(opens | turn)
            last, count = snap[-1], int(ids[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=[*batch.schema.names, "chunk"])

    cut = rows.mapInArrow(run, schema)
    # the counter restarts in each partition: the partition's number makes it unique
    return cut.withColumn("chunk", F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("chunk"))


def snapshot_changes(
    df: DataFrame,
    group: str,
    snapshot: str,
    taken: str,
    key: Column,
    value: Column,
    version: Sequence[str],
    mean_chunk: int = MEAN_CHUNK,
) -> DataFrame:
    """(group, snapshot, ``key``, ``change``) for each snapshot against the one before it in its group by ``taken``.

    ``key`` and ``value`` are normalised expressions; a record has changed if
    its ``value`` (any orderable type, null a value of its own) differs; values
    are compared by 128-bit digests. Of
    several rows of one key in one snapshot the last by ``version`` holds, rows
    equal in it are decided by value. First snapshots give nothing. Snapshots
    of equal time are ordered by id; a snapshot whose rows name several times has
    the earliest. Null keys are a key of their own; a
    snapshot that has no row at all does not exist. An empty table gives no
    rows. Other columns may have any name.
    """
    tasks = parallelism(df.sparkSession)
    slim = df.select(
        F.col(group).alias("group_"), F.col(snapshot).alias("snap_"), F.col(taken).alias("taken_"), key.alias("key_"),
        F.struct(*[F.col(v) for v in version]).alias("version_"), value.alias("value_"),
    )
    rows = _held(slim).select(
        "group_", "snap_", "taken_", "key_", F.struct("h1", "h2").alias("value_"),
        F.xxhash64("key_").alias("key_hash_"),
        F.xxhash64("group_", "snap_").alias("snap_hash_"),
    )
    # a range partitioning by the whole key splits a hot group anywhere
    rows = rows.repartitionByRange(tasks, "group_", "snap_", "key_")
    rows = rows.sortWithinPartitions("group_", "snap_", "key_")
    mask = (1 << max(0, mean_chunk.bit_length() - 1)) - 1
    cut = materialize(cut_chunks(rows, mask).drop("key_hash_", "snap_hash_"), "chunks")

    # one small row per chunk; combined in the map tasks since chunks are contiguous
    h = [F.xxhash64(F.lit(s), "key_", f"value_.h{s}") for s in (1, 2)]
    digests = cut.groupBy("group_", "snap_", "chunk").agg(
        F.min("taken_").alias("taken_"), F.count(F.lit(1)).alias("n_"), F.bit_xor(h[0]).alias("d1_"), F.bit_xor(h[1]).alias("d2_"),
        F.sum(h[0].bitwiseAND(F.lit((1 << 32) - 1))).alias("d3_"),
    )
    order = _consecutive(digests)
    later = order.where("prev_ is not null").select("group_", F.col("prev_").alias("snap_"), F.col("snap_").alias("pair_"), F.lit(-1).alias("side_"))
    sides = order.where("prev_ is not null").select("group_", "snap_", F.col("snap_").alias("pair_"), F.lit(1).alias("side_")).unionByName(later)
    sides = materialize(sides, "pairs")
    placed = digests.join(sides.withColumnRenamed("group_", "g_"), digests["group_"].eqNullSafe(F.col("g_")) & digests["snap_"].eqNullSafe(sides["snap_"])).select(
        "g_", "pair_", "side_", digests["chunk"], "n_", "d1_", "d2_", "d3_"
    )
    # a digest is matched if both sides have it; equal digests inside one side cannot be, keys are unique
    same = placed.groupBy("g_", "pair_", "n_", "d1_", "d2_", "d3_").agg(F.min("side_").alias("lo_"), F.max("side_").alias("hi_"), F.collect_set(F.struct("chunk", "side_")).alias("c_"))
    open_chunks = same.where("lo_ = hi_").select("pair_", F.explode("c_").alias("c")).select("pair_", "c.chunk", "c.side_")
    left = cut.join(open_chunks, "chunk").select("group_", "pair_", "side_", "key_", "value_")
    # one aggregation classifies a key from what either side holds of it
    now, old = F.col("side_") == 1, F.col("side_") == -1
    seen = left.groupBy("group_", "pair_", "key_").agg(
        F.max(now).alias("now_"), F.max(old).alias("old_"),
        F.max(F.when(now, F.struct("value_"))).alias("a_"), F.max(F.when(old, F.struct("value_"))).alias("b_"),
    )
    change = F.when(~F.col("old_"), "added").when(~F.col("now_"), "removed").when(~F.col("a_").eqNullSafe(F.col("b_")), "changed")
    return seen.select(F.col("group_").alias(group), F.col("pair_").alias(snapshot), F.col("key_").alias("key"), change.alias("change")).where("change is not null")


def _held(rows: DataFrame) -> DataFrame:
    """(group_, snap_, key_, taken_, h1, h2): the row that holds of each key, its value as a 128-bit digest.

    Values are digested before anything is shuffled, since from here on they
    only count as equal or different, and repeated rows are combined in the map
    tasks: a key delivered a million times is one row of each. Only where rows
    of one key and equal version differ is the greatest value looked for.
    """
    key = ["group_", "snap_", "key_"]
    told = F.to_json(F.struct(F.col("value_").alias("v")), {"ignoreNullFields": "false"})
    digest = [F.xxhash64(F.lit(s), told).alias(f"h{s}") for s in (1, 2)]
    slim = rows.select(*key, "taken_", "version_", *digest)
    # the greatest and the least digest of the last version
    high, low = F.struct("version_", "h1", "h2"), F.struct("version_", F.bitwise_not("h1").alias("h1"), F.bitwise_not("h2").alias("h2"))
    best = slim.groupBy(*key).agg(F.min("taken_").alias("taken_"), F.max(high).alias("m_"), F.max(low).alias("n_"))
    best = materialize(best.select(*key, "taken_", "m_.h1", "m_.h2", ((F.col("m_.h1") != F.bitwise_not("n_.h1")) | (F.col("m_.h2") != F.bitwise_not("n_.h2"))).alias("tied_")), "latest")
    tied = best.where("tied_").select(*[F.col(k).alias("t_" + k) for k in key])
    plain = best.select(*key, "taken_", "h1", "h2")
    if tied.isEmpty():
        return plain
    again = rows.join(tied, [rows[k].eqNullSafe(tied["t_" + k]) for k in key], "left_semi").groupBy(*key).agg(F.max(F.struct("version_", "value_")).alias("m_"))
    again = again.select(*[F.col(k).alias("t_" + k) for k in key], F.col("m_.value_").alias("value_")).select(*["t_" + k for k in key], *[d.alias("w" + str(i)) for i, d in enumerate(digest)])
    both = plain.join(again, [plain[k].eqNullSafe(again["t_" + k]) for k in key], "left")
    return both.select(*key, "taken_", F.coalesce("w0", "h1").alias("h1"), F.coalesce("w1", "h2").alias("h2"))


def _consecutive(digests: DataFrame) -> DataFrame:
    """(group_, snap_, prev_): one row per snapshot, never one per record."""
    ids = digests.groupBy("group_", "snap_").agg(F.min("taken_").alias("taken_"))
    return ids.withColumn("prev_", F.lag("snap_").over(Window.partitionBy("group_").orderBy("taken_", "snap_")))
