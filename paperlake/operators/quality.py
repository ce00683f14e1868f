"""Constraints as data-quality jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperlake.constants import COLLECTION_KEY, MEMBERSHIP_KEY, PAPER_KEY, STATUSES

KEYS = {"saved_papers": PAPER_KEY, "collections": COLLECTION_KEY, "collection_papers": MEMBERSHIP_KEY}


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def all_duplicate_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Duplicates of every stored table's key: table, key (its parts as text, joined by a slash), rows."""
    parts = []
    for name, df in tables.items():
        key = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEYS[name]])
        found = duplicate_keys(df, KEYS[name])
        parts.append(found.select(F.lit(name).alias("table"), key.alias("key"), "rows"))
    return reduce(DataFrame.unionByName, parts)


def null_violations(df: DataFrame, schema: StructType, table: str) -> DataFrame:
    """NULLs per required column in one pass: table, column_name, violations."""
    required = [f.name for f in schema.fields if not f.nullable]
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counted.unpivot([], required, "column_name", "violations").select(
        F.lit(table).alias("table"), "column_name", "violations"
    )


def all_null_violations(tables: dict[str, tuple[DataFrame, StructType]]) -> DataFrame:
    return reduce(
        DataFrame.unionByName, [null_violations(df, schema, name) for name, (df, schema) in tables.items()]
    )


def orphan_memberships(memberships: DataFrame, collections: DataFrame, saved: DataFrame) -> DataFrame:
    """Memberships without their collection or without their saved paper, with the reason."""
    held = memberships.select(*MEMBERSHIP_KEY, "user_id", "guild_id")
    no_collection = held.join(collections.select(F.col("id").alias("collection_id")), "collection_id", "left_anti")
    no_paper = held.join(saved.select(*PAPER_KEY), PAPER_KEY, "left_anti").select(*held.columns)
    return no_collection.select(*held.columns, F.lit("no_collection").alias("reason")).unionByName(
        no_paper.withColumn("reason", F.lit("no_paper"))
    )


def bad_status(saved: DataFrame) -> DataFrame:
    """Rows whose status is outside the domain."""
    return saved.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))
