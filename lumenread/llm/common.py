"""What the operators of this subpackage share: inputs, scratch tables, Arrow batches."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; together with BATCH_BYTES it bounds a Python worker's memory.
BATCH_ROWS = 2048
BATCH_BYTES = 16 << 20

class Scope:
    """The scratch tables of one run, which are deleted together and without those of others."""

    def __init__(self):
        self.paths: list[str] = []

    def clear(self, spark: SparkSession) -> None:
        """Delete them; only when no result that reads them is still needed."""
        while self.paths:
            delete(spark, self.paths.pop())

    @contextmanager
    def open(self) -> Iterator[Scope]:
        """Scratch tables made inside belong to this scope."""
        token = _scope.set(self)
        try:
            yield self
        finally:
            _scope.reset(token)


#: Where scratch tables are noted; outside of any run they stay until the session's folder goes.
_scope: ContextVar[Scope] = ContextVar("scope", default=Scope())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Keep Arrow batches small, as documents can be very long, and a worker's matrix products to its own core.

    The two limits stay set on the session, as plans are run after this returns.
    """
    spark.sparkContext.environment["OPENBLAS_NUM_THREADS"] = "1"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that setting is absent on one machine (tests) a temporary folder is made.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="lumenread-checkpoints-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{local}")
    return f"file://{local}"


def fresh_name() -> str:
    return uuid.uuid4().hex


def scratch_path(spark: SparkSession, name: str, path: str | None = None) -> str:
    """A path (a new one, or the given) that belongs to the scope at hand."""
    path = path or f"{shared_dir(spark)}/lumenread-{fresh_name()}-{name}"
    _scope.get().paths.append(path)
    return path


def write(df: DataFrame, path: str) -> DataFrame:
    """Write df to a path, over what a lost job may have left there, and read it back."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back.

    This cuts the lineage: what an executor held can be read again by any other one.
    """
    return write(df, scratch_path(df.sparkSession, name))


def stage_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no scope deletes."""
    return f"{shared_dir(spark)}/lumenread-{fresh_name()}-stage-{name}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def keyed_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns, whatever else docs holds."""
    return docs.select("doc_id", text_or_empty().alias("text"), *more)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in gone (null is an id like any other), with docs' own columns."""
    gone = gone.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")


def sized_partitions(spark: SparkSession, df: DataFrame, bytes_each: int = 8 << 20, least: int = 12) -> int:
    """Partitions for a shuffle of df's rows by the size of the files it scans, so that a task's share stays bounded."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), scanned_bytes(df) // bytes_each)


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the files that df's plan scans; relations of unknown size count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


_kept: dict = {}


def kept(key: tuple, make):
    """What a worker keeps from task to task: one object, that of the operator at work."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Free what another operator has kept in this worker."""
    if _kept:
        _kept.clear()
        gc.collect()


class Filled(dict):
    """A dict that makes missing values by a function; it keeps the first ones, up to a bound.

    Words follow a steep distribution, so the first to come hold nearly all of the frequent ones.
    """

    def __init__(self, make, most: int, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most and len(key) <= self.longest:
            self[key] = value
        return value


def documents_of(batches: Iterable) -> Iterable[tuple[list, list]]:
    """Columns doc_id and text of Arrow batches as Python lists."""
    for batch in batches:
        yield batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
