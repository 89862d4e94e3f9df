"""Filling fixed-capacity containers with items of varying length.

Optimal length buckets: the sizes of all items make one global histogram (at
most ``capacity`` entries), dynamic programming over it chooses the bucket
boundaries of least padding, and token-budget batches form inside each bucket,
from the longest bucket to the shortest. What a batch leaves that no item of its
bucket fits into is topped up from shorter buckets.

The driver handles the histogram and a plan whose length follows the number of
distinct sizes, never the items. Items find their container by their rank among
the items of their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.session import materialize, parallelism

END_TOKENS = 1


def byte_tokens(text: Column) -> Column:
    """Size of a text in the byte-level tokenizer: its UTF-8 bytes and one end token."""
    return F.octet_length(text) + F.lit(END_TOKENS)


def length_buckets(sizes: np.ndarray, counts: np.ndarray, bucket_cost: float) -> list[int]:
    """Upper boundaries of the buckets that minimise padding plus ``bucket_cost`` for each bucket.

    Padding is what items fall short of their bucket's upper boundary. Exact
    dynamic programming over the distinct sizes.
    """
    n = len(sizes)
    if not n:
        return []
    c = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    t = np.concatenate([[0], np.cumsum(counts * sizes)]).astype(float)
    best = np.zeros(n + 1)
    came = np.zeros(n + 1, int)
    for j in range(1, n + 1):
        pad = sizes[j - 1] * (c[j] - c[:j]) - (t[j] - t[:j])
        total = best[:j] + pad
        came[j] = int(total.argmin())
        best[j] = total[came[j]] + bucket_cost
    out, j = [], n
    while j:
        out.append(int(sizes[j - 1]))
        j = came[j]
    return out[::-1]


@dataclass
class Plan:
    """Runs of items of one size: ranks from ``rank`` on go to containers from ``container`` on, ``each`` to one."""

    size: list[int]
    rank: list[int]
    container: list[int]
    each: list[int]
    containers: int
    used: int
    boundaries: list[int]


def plan(histogram: dict[int, int], capacity: int, top_up: bool = True) -> Plan:
    """Container plan for a histogram of sizes, all from 1 to ``capacity``.

    Buckets are emptied from the longest to the shortest. A batch takes items
    of its own bucket as long as one fits; with ``top_up`` what then is left of
    its budget goes to the largest items of shorter buckets that fit.
    """
    sizes = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    bounds = length_buckets(sizes, left, float(capacity))
    bucket = np.searchsorted(np.array(bounds, dtype=np.int64), sizes)
    rank = np.zeros(len(sizes), np.int64)
    out = Plan([], [], [], [], 0, int((sizes * left).sum()), bounds)
    for b in range(len(bounds) - 1, -1, -1):
        own, shorter = np.flatnonzero((bucket == b) & (left > 0)), np.flatnonzero((bucket < b) & (left > 0))
        while len(own):
            used, gap = _batch(sizes[own], left[own], capacity)
            used = {int(own[i]): n for i, n in used.items()}
            if top_up:
                used |= _fill(sizes, left, shorter, gap)
            times = min(int(left[i]) // u for i, u in used.items())
            for i, u in used.items():
                out.size.append(int(sizes[i]))
                out.rank.append(int(rank[i]))
                out.container.append(out.containers)
                out.each.append(u)
                rank[i] += u * times
                left[i] -= u * times
            out.containers += times
            own, shorter = own[left[own] > 0], shorter[left[shorter] > 0]
    return out


def _batch(sizes: np.ndarray, left: np.ndarray, budget: int) -> tuple[dict[int, int], int]:
    """One batch from a bucket's ascending ``sizes``, as {index: number}, and the budget that is left.

    The longest item opens it. Further items are of the size that divides the
    rest of the budget evenly by the number of mean items it still holds, so
    that the last two can meet it exactly; they are the pair whose sum comes
    nearest to it, or the largest one that fits.
    """
    used = {len(sizes) - 1: 1}
    gap = budget - int(sizes[-1])
    mean = float((sizes * left).sum() / left.sum())
    free = lambda i: int(left[i]) - used.get(i, 0)
    while gap >= sizes[0]:
        r = max(1, round(gap / mean))
        if r == 2 and (pair := _pair(sizes, left, used, gap)) is not None:
            picks = pair
        else:
            most = int(np.searchsorted(sizes, gap, side="right")) - 1
            at = min(most, int(np.searchsorted(sizes, gap / r, side="right")) - 1) if r > 1 else most
            at = max(at, 0)
            # the nearest size of which an item is free, below before above
            i = next((k for k in range(at, -1, -1) if free(k)), None)
            if i is None:
                i = next((k for k in range(at + 1, most + 1) if free(k)), None)
            if i is None:
                break
            picks = (i,)
        for i in picks:
            used[i] = used.get(i, 0) + 1
            gap -= int(sizes[i])
    return used, gap


def _pair(sizes: np.ndarray, left: np.ndarray, used: dict[int, int], gap: int) -> tuple[int, int] | None:
    """Two free items of largest sum up to ``gap``."""
    can = left.copy()
    for i, n in used.items():
        can[i] -= n
    free = np.flatnonzero(can > 0)
    s = sizes[free]
    mate = np.searchsorted(s, gap - s, side="right") - 1
    ok = (mate >= 0) & ((mate != np.arange(len(free))) | (can[free] > 1))
    if not ok.any():
        return None
    total = np.where(ok, s + s[np.maximum(mate, 0)], -1)
    i = int(total.argmax())
    return int(free[i]), int(free[mate[i]])


def _fill(sizes: np.ndarray, left: np.ndarray, among: np.ndarray, gap: int) -> dict[int, int]:
    """Largest-fit-first from the sizes ``among`` (ascending indices with items left)."""
    used: dict[int, int] = {}
    s = sizes[among]
    k = int(np.searchsorted(s, gap, side="right")) - 1
    while k >= 0:
        take = min(gap // int(s[k]), int(left[among[k]]))
        used[int(among[k])] = take
        gap -= take * int(s[k])
        k = min(k, int(np.searchsorted(s, gap, side="right"))) - 1
    return used


def pieces(df: DataFrame, item: str, text: str, capacity: int) -> DataFrame:
    """(item, piece, pieces, char_start, char_end, tokens) of every text that is not null.

    Texts of at most ``capacity`` tokens are one piece. Longer ones are cut
    between code points into pieces as large as fit, each with an end token
    of its own.
    """
    size = byte_tokens(F.col(text))
    t = df.where(F.col(text).isNotNull())
    whole = t.where(size <= capacity).select(
        F.col(item).alias("item"), F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).alias("char_start"), F.length(text).alias("char_end"), size.cast("int").alias("tokens")
    )
    kind = df.schema[item].dataType.simpleString()
    room = capacity - END_TOKENS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows: list[tuple[int, int, int, int, int, int]] = []
            for k, s in enumerate(x.column(1).to_pylist()):
                b = s.encode()
                ends, at = [], 0
                while at < len(b):
                    end = min(at + room, len(b))
                    while end < len(b) and b[end] & 0xC0 == 0x80:
                        end -= 1
                    if end == at:
                        raise ValueError("the capacity is smaller than one character")
                    ends.append(end)
                    at = end
                at = chars = 0
                for p, end in enumerate(ends):
                    n = len(b[at:end].decode())
                    rows.append((k, p, len(ends), chars, chars + n, end - at + END_TOKENS))
                    at, chars = end, chars + n
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(cols[0], pa.int32())), *[pa.array(c, pa.int32()) for c in cols[1:]]], names=["item", "piece", "pieces", "char_start", "char_end", "tokens"])

    long = t.where(size > capacity).select(F.col(item).alias("item"), F.col(text).alias("t"))
    split = long.mapInArrow(cut, f"item {kind}, piece int, pieces int, char_start int, char_end int, tokens int")
    return whole.unionByName(split)


def pack(df: DataFrame, item: str, text: str, capacity: int, top_up: bool = True) -> DataFrame:
    """(``item``, piece, pieces, char_start, char_end, tokens, bucket, container) of every text.

    No container holds more than ``capacity`` tokens, no text is split that
    fits into one. Null texts are no items, an empty text has its end token;
    equal texts are items of their own and item ids should be unique (rows of
    equal id and piece still each get a place). ``bucket`` is the upper
    boundary of the item's length bucket. With ``top_up`` off, batches hold
    items of one bucket only. An empty table gives no rows.
    """
    if capacity <= END_TOKENS:
        raise ValueError("capacity must exceed the end token")
    spread = 4 * parallelism(df.sparkSession)
    parts = pieces(df, item, text, capacity).withColumn("slot_", F.pmod(F.xxhash64("item", "piece"), F.lit(spread)).cast("int"))
    parts = materialize(parts, "pieces")
    # at most capacity x spread rows, whatever the number of items
    counts = materialize(parts.groupBy("tokens", "slot_").agg(F.count(F.lit(1)).alias("n_")), "sizes")
    sizes = {r[0]: r[1] for r in counts.groupBy("tokens").agg(F.sum("n_")).collect()}
    p = plan(sizes, capacity, top_up)
    before = Window.partitionBy("tokens").orderBy("slot_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tokens", "slot_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("offset_"))
    # a size that a third of all items have is ranked in ``spread`` slots
    order = Window.partitionBy("tokens", "slot_").orderBy("item", "piece")
    ranked = parts.withColumn("r_", F.row_number().over(order)).join(offsets, ["tokens", "slot_"]).withColumn("rank_", F.col("offset_") + F.col("r_") - 1)

    at = np.lexsort((np.array(p.rank), np.array(p.size))) if p.size else np.array([], int)
    size, rank, first, each = (np.array(v, dtype=np.int64)[at] for v in (p.size, p.rank, p.container, p.each))
    bounds = np.array(p.boundaries, dtype=np.int64)
    key = (size << 44) + rank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            t = x.column("tokens").to_numpy(zero_copy_only=False).astype(np.int64)
            r = x.column("rank_").to_numpy(zero_copy_only=False)
            run = np.searchsorted(key, (t << 44) + r, side="right") - 1
            where = first[run] + (r - rank[run]) // each[run]
            upper = bounds[np.searchsorted(bounds, t)]
            yield pa.RecordBatch.from_arrays(
                [*[x.column(c) for c in ("item", "piece", "pieces", "char_start", "char_end", "tokens")], pa.array(upper.astype(np.int32)), pa.array(where)],
                names=["item", "piece", "pieces", "char_start", "char_end", "tokens", "bucket", "container"],
            )

    kind = df.schema[item].dataType.simpleString()
    schema = f"item {kind}, piece int, pieces int, char_start int, char_end int, tokens int, bucket int, container long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("item", item)
