"""Session helpers: the shared folder and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only where that setting is absent (tests, a single machine) a folder of
    our own is made and registered as checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="depweave-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, survives the loss of executors and makes what was
    computed by Python or by a sampled range partitioning the same for every
    later reader. ``by`` names a column of few values that partitions the files,
    for readers that want some of them. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/depweave/{label}-{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path)
    else:  # one open file for each value instead of a sort
        with _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "16"):
            df.write.partitionBy(by).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that an operator writes on its way are deleted when it ends, but for those it puts into the list."""
    before = len(_written)
    keep: list[DataFrame] = []
    try:
        yield keep
    finally:
        kept = {getattr(df, "_table_path", None) for df in keep}
        mine = _written[before:]
        _written[before:] = [x for x in mine if x[1] in kept]
        for x in mine:
            if x[1] not in kept:
                _delete(*x)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already
        pass


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def materialize_counted(df: DataFrame, label: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """``materialize``, and the number of rows (from the files' footers), or of rows for which ``what`` is true."""
    out = materialize(df, label)
    return out, (out if what is None else out.where(what)).count()


@contextmanager
def sized_partitions(spark: SparkSession) -> Iterator[None]:
    """Lets adaptive execution merge partitions up to the advisory size instead of keeping every core busy.

    For loops whose rounds are often tiny: a round then writes few files, and
    the next does not start a task for each of many empty ones.
    """
    with _setting(spark, "spark.sql.adaptive.coalescePartitions.parallelismFirst", "false"):
        yield


def in_sized_partitions(f: Callable) -> Callable:
    """Runs an operator's rounds within ``sized_partitions``; the first argument is a DataFrame or has ``edges``."""

    @wraps(f)
    def run(first, *args, **kw):  # noqa: ANN001
        with sized_partitions(getattr(first, "edges", first).sparkSession):
            return f(first, *args, **kw)

    return run


def drop_tables() -> None:
    """Delete every table that ``materialize`` wrote in this process."""
    while _written:
        _delete(*_written.pop())


atexit.register(drop_tables)


def parallelism(spark: SparkSession) -> int:
    """Number of reduce tasks that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(base: str, *taken: list[str]) -> str:
    """``base``, or ``base`` with underscores, so that no column in ``taken`` has the name."""
    names = {c.lower() for cols in taken for c in cols}
    while base.lower() in names:
        base += "_"
    return base
