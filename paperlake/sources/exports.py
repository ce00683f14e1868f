"""Citation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.sources.files import NAME, NamedFiles


def _folder_key(column: str) -> Column:
    # a prefix keeps the empty guild a real folder name instead of the NULL partition
    return F.concat(F.lit("g:" if column == "guild_id" else "u:"), F.col(column))


def write_collection_files(lines: DataFrame, path: str) -> None:
    """Write export lines (see ``collections.export_lines``) as text, one folder per file name.

    Rows are range partitioned by file and position, so one very large collection
    becomes several ordered part files instead of one task.
    """
    keys = ["user_id", "guild_id", "file_name"]
    rows = lines.select(
        "text",
        _folder_key("user_id").alias("user_id"),
        _folder_key("guild_id").alias("guild_id"),
        "file_name",
        "position",
    )
    (
        rows.repartitionByRange(*keys, "position")
        .sortWithinPartitions(*keys, "position")
        .drop("position")
        .write.partitionBy(*keys)
        .text(path)
    )


def write_citation_files(payloads: DataFrame, path: str) -> None:
    """Write the payloads that go to a file, one folder per paper file name."""
    (
        payloads.where(F.col("delivery") == "file")
        .select(F.col("citation").alias("text"), "file_name")
        .write.partitionBy("file_name")
        .text(path)
    )


def write_packed(lines: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Export lines of all files in few Parquet files, ``file_name`` and tenant as columns.

    For very many tenants or papers, where a folder per file would be a burden to the store. Rows
    are ordered by file and position, so a reader takes one file's lines from neighbouring rows.
    """
    order = [c for c in ("user_id", "guild_id", "file_name", "position") if c in lines.columns]
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def _folder_name(column: str) -> Column:
    # as in write_collection_files; a file system may not take a colon
    return F.concat(F.lit("g=" if column == "guild_id" else "u="), F.replace(F.coalesce(F.col(column), F.lit("")), F.lit("/"), F.lit("%2F")))


def _write_named(rows: DataFrame, path: str) -> None:
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.write.format(NAME).mode("append").option("path", path).save()


def write_exact_collection_files(lines: DataFrame, path: str) -> None:
    """Export lines as one file per collection, ``u=<user>/g=<guild>/<name>.<extension>``.

    Its content is the citations with a blank line between them. Files appear when all are complete.
    """
    keys = ["folder", "file_name"]
    rows = lines.withColumn("folder", F.concat_ws("/", _folder_name("user_id"), _folder_name("guild_id")))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "collection_id", "position")
    _write_named(rows.select(*keys, "text"), path)


def write_exact_citation_files(payloads: DataFrame, path: str) -> None:
    """Payloads that go to a file as one file per name; a paper asked for more than once is written once."""
    files = payloads.where(F.col("delivery") == "file").groupBy("file_name").agg(F.min("citation").alias("text"))
    _write_named(files.select(F.lit("").alias("folder"), "file_name", "text"), path)
