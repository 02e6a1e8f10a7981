"""Durable cuts of lineage: written tables in the folder that the cluster shares.

A written table is used rather than ``DataFrame.checkpoint``: it survives lost executors in the same way, but is
columnar and compressed, and its true size is known to the planner (a checkpointed frame carries the estimates of the
plan that made it; in iterative jobs these multiply until planning itself becomes the bottleneck).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def _drop(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has been stopped
        if "://" not in root:
            shutil.rmtree(root.removeprefix("file:"), ignore_errors=True)


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder below ``spark.checkpoint.dir``.

    Where that is unset it is below the warehouse, if a cluster shares that, else it has to be set; a local session takes a temporary folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="checkpoints-")
        if not base:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
            if base.startswith(("/", "file:")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is on one machine")
        _roots[app] = f"{base.rstrip('/')}/tables-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_drop, spark, _roots[app])
    return _roots[app]


def durable(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that lost executors cost no recomputation of it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
