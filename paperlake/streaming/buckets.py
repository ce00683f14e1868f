"""Tables that a stream appends to, one folder per batch, in buckets of a key.

``<path>/<table>/batch=<k>/bucket=<b>`` is what batch k wrote; it overwrites only its own folder, so a
batch that runs again changes nothing. ``<path>/<table>/upto=<n>`` is a base: everything up to batch n
in one place. A base counts once its write is complete; from then on the folders it replaces are
not read any more and are removed. Readers ask for the buckets they need and get no other files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKETS = 64


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class BatchTable:
    def __init__(self, spark: SparkSession, path: str, name: str, schema: StructType, keys: list[str]) -> None:
        self.spark, self.root, self.keys = spark, f"{path.rstrip('/')}/{name}", keys
        self.schema = StructType([*schema.fields, StructField("bucket", IntegerType())])
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self) -> tuple[int, list[int]]:
        """Last batch of the base (-1 without one) and the complete batches behind it."""
        if not self._fs.exists(self._path(self.root)):
            return -1, []
        found: dict[str, list[int]] = {"upto": [], "batch": []}
        for status in self._fs.listStatus(self._path(self.root)):
            kind, _, number = status.getPath().getName().partition("=")
            if kind in found and self._fs.exists(self._path(f"{self.root}/{kind}={number}/_SUCCESS")):
                found[kind].append(int(number))
        base = max(found["upto"], default=-1)
        return base, sorted(k for k in found["batch"] if k > base)

    def base(self) -> int:
        return self._folders()[0]

    def before(self, batch: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the base and of the batches before ``batch`` (all of them by default), with ``batch``."""
        base, batches = self._folders()
        parts = [(base, f"upto={base}")] if base >= 0 else []
        parts += [(k, f"batch={k}") for k in batches if batch is None or k < batch]
        out = None
        for number, folder in parts:
            rows = self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}")
            if buckets is not None:
                rows = rows.where(F.col("bucket").isin(buckets))
            rows = rows.withColumn("batch", F.lit(number).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            out = self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(0).cast("long"))
        return out.drop("bucket")

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema if f.name != "bucket"], bucket_of(self.keys).alias("bucket"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}")

    def put(self, rows: DataFrame, batch: int) -> None:
        self._write(rows, f"batch={batch}")

    def fold(self, rows: DataFrame, upto: int) -> None:
        """Make ``rows`` the base up to batch ``upto`` and remove what it replaces."""
        base, batches = self._folders()
        if upto <= base:
            return
        self._write(rows, f"upto={upto}")
        for folder in [f"upto={base}", *[f"batch={k}" for k in batches if k <= upto]]:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
