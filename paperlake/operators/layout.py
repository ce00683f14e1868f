"""Old table layouts brought up to date; tables already in the new layout pass unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.constants import DEFAULT_STATUS

ADDED_COLUMNS = {"status": DEFAULT_STATUS, "note": None, "summary": None}


def add_missing_columns(saved: DataFrame) -> DataFrame:
    """Add the columns later versions introduced, with their defaults."""
    missing = {
        name: F.lit(default).cast("string") for name, default in ADDED_COLUMNS.items() if name not in saved.columns
    }
    return saved.withColumns(missing) if missing else saved


def add_guild(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Give all three tables an empty guild when saved_papers is still without one."""
    if "guild_id" in tables["saved_papers"].columns:
        return tables
    return {
        name: df if "guild_id" in df.columns else df.withColumn("guild_id", F.lit(""))
        for name, df in tables.items()
    }


def upgrade(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Columns first, then the guild, as the tables evolved."""
    return add_guild({**tables, "saved_papers": add_missing_columns(tables["saved_papers"])})
