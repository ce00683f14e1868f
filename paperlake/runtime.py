"""Session helpers: durable cut points and run-unique folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_LOCAL_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by the session.

    Only a local session without the setting gets a temporary folder of its own;
    on a cluster such a folder would not outlive an executor.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
        root = _LOCAL_ROOTS.get(context.applicationId) or tempfile.mkdtemp(prefix="paperlake-")
        _LOCAL_ROOTS[context.applicationId] = root
    return root.rstrip("/")


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the checkpoint root, removed when the application ends."""
    path = f"{checkpoint_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def durable(df: DataFrame, purpose: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the written rows.

    The rows keep their columnar format, so later readers prune columns and push filters;
    the schema is given, not inferred. The files go when the application ends.
    """
    path = run_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
