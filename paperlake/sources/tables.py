"""Library tables: parquet snapshots, and JDBC where the user supplies a driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.sources.schemas import TABLES


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{folder.rstrip('/')}/{table}")


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {table: read_table(spark, folder, table) for table in TABLES}


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Write a new snapshot folder; an existing one is never overwritten.

    Rows are clustered by tenant so that tenant filters skip row groups, and the
    extra paper key keeps a large tenant from landing in one file.
    """
    for table, df in tables.items():
        spread = "name" if table == "collections" else "paper_id"
        (
            df.repartitionByRange("user_id", "guild_id", spread)
            .sortWithinPartitions("user_id", "guild_id", spread)
            .write.mode("errorifexists")
            .parquet(f"{folder.rstrip('/')}/{table}")
        )


def read_jdbc(
    spark: SparkSession, url: str, table: str, partitions: int = 1, properties: dict[str, str] | None = None
) -> DataFrame:
    """Read a live library table; needs the database's driver jar on the class path.

    Tables with a numeric id are read in ``partitions`` ranges of it. Instants are
    stored there as ISO text and are turned into timestamps here.
    """
    schema = TABLES[table]
    options = {"url": url, "dbtable": table, **(properties or {})}
    reader = spark.read.format("jdbc").options(**options)
    if partitions > 1 and "id" in schema.fieldNames():
        low, high = (
            spark.read.format("jdbc")
            .options(url=url, query=f"select min(id) as low, max(id) as high from {table}", **(properties or {}))
            .load()
            .first()
        )
        if low is not None:
            reader = reader.options(
                partitionColumn="id", lowerBound=low, upperBound=high + 1, numPartitions=partitions
            )
    raw = reader.load()
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
