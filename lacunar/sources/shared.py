"""The folder that the driver and all executors share, and frames cut off from their lineage there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session may do without the setting: it gets a private
    folder of its own, which is removed when the process ends."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lacunar-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def short_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of this session end at `most` bytes, not only at 10,000 rows: with long texts those are large, and the
    JVM and the Python workers hold several each. A smaller limit that is set already holds."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > most:
        spark.conf.set(name, str(most))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


#: Paths written inside scratch(), innermost last.
_written: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What cut() and store() write in here is removed at the end, also after a failure. For blocks whose result does not
    depend on it any more, such as a stage whose output has been written."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            _delete(spark, path)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that is made and run in here go when it ends, not when the driver next happens to collect
    its garbage. For queries whose result is written; should one be read again all the same, Spark runs its stages again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def _checkpoint_of(df: DataFrame) -> str | None:
    """The folder of a frame that cut() returned."""
    plan = df._jdf.logicalPlan()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    return file.get() if file is not None and file.isDefined() else None


def cut(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder, so that losing an executor never recomputes what led to it."""
    shared_dir(df.sparkSession)
    with _shuffles_go(df.sparkSession):
        out = df.select("*").checkpoint(eager=True)  # the select makes a query of its own here
    if _written and (path := _checkpoint_of(out)):
        _written[-1].append(path)
    return out


def uncut(*frames: DataFrame) -> None:
    """Removes what cut() wrote for these frames, which nothing may read any more."""
    for df in frames:
        if path := _checkpoint_of(df):
            _delete(df.sparkSession, path)


def store(df: DataFrame, what: str) -> DataFrame:
    """As cut(), for a larger frame: a Parquet table in the shared folder, under a name used once."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    return df.sparkSession.read.parquet(path)


def dealt(df: DataFrame, n: int, keys: list[str], shuffle: bool = True, codec: str = "snappy") -> DataFrame:
    """As store(), in n buckets by the hash of `keys`: joins of tables dealt alike shuffle nothing. Without `shuffle` the
    rows of a partition must belong to few buckets already. forget() removes the table."""
    spark, name = df.sparkSession, f"lacunar_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    rows = df.repartition(n, *keys) if shuffle else df
    if _written:
        _written[-1].append(path)
    rows.write.option("path", path).option("compression", codec).bucketBy(n, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    out = spark.table(name)
    _tables[out] = (name, path)
    return out


#: Names and paths of the tables that dealt() has made.
_tables: WeakKeyDictionary = WeakKeyDictionary()


def forget(spark: SparkSession, what: DataFrame | str | None) -> None:
    """Removes a table of dealt(), or a path. Other frames are left alone."""
    if isinstance(what, str):
        _delete(spark, what)
    elif what is not None and (known := _tables.pop(what, None)):
        spark.sql(f"DROP TABLE IF EXISTS {known[0]}")
        _delete(spark, known[1])
