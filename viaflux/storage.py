"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it back.
The folder is the one the cluster names in ``spark.checkpoint.dir``; a folder of
our own is used only where that setting is absent and the master is local. Tables
that an operator has not dropped itself go when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Only for sessions that name no shared folder.
LOCAL_ROOT = "file:///tmp/checkpoints/viaflux"


#: Spark then removes the shuffle files of a query as it ends, not at some later collection.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or LOCAL_ROOT


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once for a Spark context."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top, raw = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    path = os.path.join(tempfile.mkdtemp(), "viaflux.zip")
    Path(path).write_bytes(raw.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Make ready for Python code: the package on all workers, Arrow batches small enough for very long texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_roots: dict[str, SparkSession] = {}


@atexit.register
def _clear() -> None:
    for root, spark in _roots.items():
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, root)
        except Exception:  # noqa: BLE001, the JVM may be gone already
            return


class Scratch:
    """Tables of one run of an operator; ``drop`` frees one as soon as it is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_root(spark).rstrip('/')}/viaflux-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, tag: str = "t") -> DataFrame:
        """Write df, return it as a plain scan; its name is kept in ``df.scratch_path``."""
        self.n += 1
        path = f"{self.root}/{self.n:04d}_{tag}"
        _roots[self.root] = self.spark
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t.scratch_path)
