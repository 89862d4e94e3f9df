"""Differences between two copies of a data set, field by field.

Characteristic-polynomial set reconciliation. Rows are hashed into a prime
field and into buckets by key. Each side sends, per bucket, only the values of
prod(z - hash) at a few points z; the quotient of both sides' values is a
rational function whose numerator and denominator have the differing hashes as
roots. It is interpolated for a degree bound, verified at spare points, and the
bound doubles for buckets that fail. Each side then finds which of its own
hashes are roots, and only those rows are fetched and compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.operators import field61 as gf
from depweave.session import materialize, parallelism

ROWS_PER_BUCKET = 32
FIRST_DEGREE = 8
SPARE_POINTS = 2
BROADCAST_KEYS = 500_000  # 8 bytes each
STEPS_PER_TASK = 5_000_000  # of elimination
HASH_BITS = 60  # hashes are below 2**60, sample points above: no sample is ever a root


@dataclass(frozen=True)
class Field:
    """A compared field: its normalised value, and for numbers the difference that still counts as equal."""

    name: str
    value: Column
    tolerance: float | None = None

    def hashed(self) -> Column:
        """What the row hash sees: equal cells are never farther apart than the tolerance."""
        if self.tolerance is None:
            return F.col(self.name)
        x = F.col(self.name)
        return F.when(F.isnan(x), F.lit("NaN")).otherwise(F.round(x / F.lit(self.tolerance)).cast("string"))

    def differs(self, a: Column, b: Column) -> Column:
        if self.tolerance is None:
            return ~a.eqNullSafe(b)
        nan = F.isnan(a) | F.isnan(b)
        far = F.when(nan, ~a.eqNullSafe(b)).otherwise(F.abs(a - b) > F.lit(self.tolerance))
        return (a.isNull() != b.isNull()) | F.coalesce(far, F.lit(False))


def _points(n: int) -> np.ndarray:
    return (np.uint64(1) << np.uint64(HASH_BITS)) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(982451653)


def keyed(df: DataFrame, key: dict[str, Column], fields: Sequence[Field], version: str) -> DataFrame:
    """Normalised rows with ``kh`` and ``kl``, the two halves of the key's hash, and the row's hash ``h``."""
    slim = df.select(*[c.alias(k) for k, c in key.items()], *[f.value.alias(f.name) for f in fields], F.col(version).alias("version_"))
    values = F.to_json(F.struct(*[f.hashed().alias(f.name) for f in fields]), {"ignoreNullFields": "false"})
    names = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    rows = slim.withColumn("kh", F.xxhash64(F.lit(17), names)).withColumn("kl", F.xxhash64(F.lit(29), names))
    return rows.withColumn("h", F.xxhash64(F.lit(61), names, values).bitwiseAND(F.lit((1 << HASH_BITS) - 1)))


def latest_hashes(rows: DataFrame) -> DataFrame:
    """(kh, h) of the row of each key that is last by version, equal versions decided by hash; 32 bytes a row are shuffled."""
    best = rows.groupBy("kh", "kl").agg(F.max(F.struct("version_", "h")).alias("m_"))
    return best.select("kh", F.col("m_.h").alias("h"))


def latest_rows(rows: DataFrame, key: dict[str, Column], fields: Sequence[Field]) -> DataFrame:
    """The rows that ``latest_hashes`` stands for."""
    best = rows.groupBy(*key).agg(F.max(F.struct("version_", "h", *[f.name for f in fields])).alias("m_"))
    return best.select(*key, *[F.col(f"m_.{f.name}").alias(f.name) for f in fields])


def sketch(hashes: DataFrame, degree: int) -> DataFrame:
    """(bucket, n, values): size and characteristic polynomial of each bucket at ``degree`` + spare points.

    ``hashes`` is (bucket, h). A bucket's rows meet in one task (buckets are
    of bounded size, by hash of the key) but only its sketch leaves it.
    """
    z = _points(degree + SPARE_POINTS)
    schema = "bucket long, n long, v array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = n = v = None  # of the bucket that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            b = batch.column(0).to_numpy(zero_copy_only=False)
            h = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            ids, counts = b[starts], np.diff(np.append(starts, len(b)))
            prods = gf.segment_products(gf.sub(np.broadcast_to(z, (len(h), len(z))), h[:, None]), starts)
            if bucket is not None:
                if ids[0] == bucket:
                    counts[0] += n
                    prods[0] = gf.mul(prods[0], v)
                else:
                    yield _sketch_batch(np.array([bucket]), np.array([n]), v[None, :])
            if len(ids) > 1:
                yield _sketch_batch(ids[:-1], counts[:-1], prods[:-1])
            bucket, n, v = ids[-1], counts[-1], prods[-1]
        if bucket is not None:
            yield _sketch_batch(np.array([bucket]), np.array([n]), v[None, :])

    return hashes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _lists(m: np.ndarray) -> pa.Array:
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).astype(np.int64).ravel()))


def _sketch_batch(ids: np.ndarray, counts: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), _lists(v)], names=["bucket", "n", "v"])


def interpolate(na: np.ndarray, nb: np.ndarray, va: np.ndarray, vb: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numerators and denominators (n x degree+1, lowest first) and whether they hold at the spare points."""
    z = _points(degree + SPARE_POINTS)
    n = len(na)
    num, den, ok = np.zeros((n, degree + 1), np.uint64), np.zeros((n, degree + 1), np.uint64), np.zeros(n, bool)
    powers = np.ones((degree + 1, len(z)), np.uint64)
    for k in range(1, degree + 1):
        powers[k] = gf.mul(powers[k - 1], z)
    delta = na - nb
    for d in np.unique(delta):
        if abs(int(d)) > degree:
            continue
        i = np.flatnonzero(delta == d)
        total = degree - ((degree + int(d)) & 1)
        da, db = (total + int(d)) // 2, (total - int(d)) // 2
        # num(z) * vb = den(z) * va at every point: nothing need be divided
        aj, bj = va[i][:, :total], vb[i][:, :total]
        a = np.empty((len(i), total, total), np.uint64)
        a[:, :, :da] = gf.mul(bj[:, :, None], powers[:da, :total].T[None])
        a[:, :, da:] = gf.sub(np.zeros(1, np.uint64), gf.mul(aj[:, :, None], powers[:db, :total].T[None]))
        rhs = gf.sub(gf.mul(aj, powers[db, :total][None]), gf.mul(bj, powers[da, :total][None]))
        x, fits = gf.solve(a, rhs) if total else (np.zeros((len(i), 0), np.uint64), np.ones(len(i), bool))
        num[i, :da], den[i, :db] = x[:, :da], x[:, da:]
        num[i, da] = den[i, db] = 1
        for j in range(total, len(z)):
            at = np.broadcast_to(z[j], (len(i),))
            fits = fits & (gf.mul(gf.horner(num[i], at), vb[i, j]) == gf.mul(va[i, j], gf.horner(den[i], at)))
        ok[i] = fits
    return num, den, ok


def solve_buckets(a: DataFrame, b: DataFrame, degree: int, buckets: int) -> DataFrame:
    """(bucket, ok, num, den) of the buckets in which the two sketches differ, of at most ``buckets``."""
    width = degree + SPARE_POINTS
    one = F.array_repeat(F.lit(1).cast("long"), width)
    left = a.select("bucket", F.col("n").alias("na"), F.col("v").alias("va"))
    right = b.select("bucket", F.col("n").alias("nb"), F.col("v").alias("vb"))
    both = left.join(right, "bucket", "full").select(
        "bucket", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"), F.coalesce("va", one).alias("va"), F.coalesce("vb", one).alias("vb")
    )
    # few bytes and much arithmetic: as many tasks as have a second's work, which are not merged by size
    tasks = min(parallelism(a.sparkSession), buckets * degree**3 // STEPS_PER_TASK + 1)
    open_ = both.where("na != nb or va != vb").repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 21) // (degree * degree))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                x = whole.slice(at, step)
                na, nb = (x.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                va, vb = (x.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(-1, width) for k in (3, 4))
                num, den, ok = interpolate(na, nb, va, vb, degree)
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(ok), _lists(num), _lists(den)], names=["bucket", "ok", "num", "den"])

    return open_.mapInArrow(run, "bucket long, ok boolean, num array<long>, den array<long>")


def roots(hashes: DataFrame, polynomials: DataFrame, which: str) -> DataFrame:
    """The (bucket, h, kh) of a side that are roots of its bucket's polynomial."""
    near = hashes.join(polynomials.select("bucket", F.col(which).alias("poly")), "bucket").select("bucket", "h", "kh", "poly")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                poly = x.column(3)
                width = len(poly[0])
                coef = poly.flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(-1, width)
                h = x.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
                yield x.select([0, 1, 2]).filter(pa.array(gf.horner(coef, h) == 0))

    return near.mapInArrow(run, "bucket long, h long, kh long")


def differing(a: DataFrame, b: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, first_degree: int = FIRST_DEGREE) -> tuple[DataFrame, DataFrame]:
    """For two written tables of (kh, h) with unique h: the (bucket, h, kh) that only the first, only the second holds.

    The number of buckets follows the number of rows; the degree bound starts
    at ``first_degree`` and doubles for the buckets that could not be verified,
    until it exceeds every bucket's size and cannot fail.
    """
    n = max(a.count(), b.count())
    buckets = max(1, n // rows_per_bucket)
    bucket = F.pmod("kh", F.lit(buckets)).alias("bucket")
    sides = [s.select(bucket, "h", "kh") for s in (a, b)]
    open_, degree = None, first_degree
    found: list[tuple[DataFrame, DataFrame]] = []
    while True:
        # written first: on top of a join the planner may leave out the sketch's partitioning and then read a bucket in several tasks
        part = sides if open_ is None else [materialize(s.join(open_, "bucket", "left_semi"), "open") for s in sides]
        solved = materialize(solve_buckets(*[sketch(x.select("bucket", "h"), degree) for x in part], degree, buckets), "polynomials")
        good = solved.where("ok")
        found.append((roots(part[0], good, "num"), roots(part[1], good, "den")))
        open_ = solved.where("not ok").select("bucket")
        buckets = open_.count()
        if not buckets:
            break
        degree *= 2
    out = found[0]
    for f in found[1:]:
        out = (out[0].unionByName(f[0]), out[1].unionByName(f[1]))
    return out


def _with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of differing keys: by a broadcast of at most ``BROADCAST_KEYS`` hashes, else by a shuffle."""
    small = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if small else keys, "kh", "left_semi")


def reconcile(
    local: DataFrame, other: DataFrame, key: dict[str, Column], fields: Sequence[Field], version: str, only: tuple[str, str]
) -> DataFrame:
    """(key..., field): the keys that one side lacks and the fields that differ.

    ``only`` names the findings for keys of the first and of the second side
    alone. Per side the row that is last by ``version`` holds, of equal
    versions one that their hashes decide. Nulls in keys
    and fields are values of their own; NaN equals NaN; arrays are compared as
    the normalised ``Field.value`` gives them; two empty sides agree. Result
    columns are the names in ``key`` and ``field``, whatever else the tables
    hold. Two different rows of a bucket are taken for the same only if their
    60-bit hashes collide.
    """
    sides = [keyed(df, key, fields, version) for df in (local, other)]
    diff = differing(*[materialize(latest_hashes(s), "hashes") for s in sides])
    fetched = [latest_rows(_with_keys(s, materialize(d.select("kh").distinct(), "roots")), key, fields).withColumn("side_", F.lit(i)) for i, (s, d) in enumerate(zip(sides, diff))]
    both = fetched[0].unionByName(fetched[1])
    row = F.struct(*[f.name for f in fields])
    pair = both.groupBy(*key).agg(F.max(F.when(F.col("side_") == 0, row)).alias("a_"), F.max(F.when(F.col("side_") == 1, row)).alias("b_"))
    told = [F.when(f.differs(F.col(f"a_.{f.name}"), F.col(f"b_.{f.name}")), F.lit(f.name)) for f in fields]
    names = (
        F.when(F.col("b_").isNull(), F.array(F.lit(only[0])))
        .when(F.col("a_").isNull(), F.array(F.lit(only[1])))
        .otherwise(F.array_compact(F.array(*told)))
    )
    return pair.select(*key, F.explode(names).alias("field"))
