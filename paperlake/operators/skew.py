"""Hot groups: one tenant, term or key may own a large share of all rows.

Three tools, all exact:

* ``salted_lookup`` joins on keys that may own very many rows on either side, spreading such keys over salts.
* ``ordered_chunks`` cuts hot groups into ordered pieces of bounded size so that
  order-dependent work (ranks, running state) never needs a whole group in a task.
* ``rank_in_group`` numbers rows inside groups of any size on top of it.

The line above which a key is hot is a constant: it says how much one task may hold or make, and
does not grow with the data. Lists of hot keys are broadcast only within a measured or fixed
bound; beyond it they are joined like any other table.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.runtime import durable

HOT_ROWS = 1_000_000
#: Bytes of a list of hot keys that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Keys that ``salted_lookup`` spreads, the largest first; smaller ones stay with adaptive splitting.
SPREAD_KEYS = 10_000


def measured_bytes(df: DataFrame) -> int:
    row = F.octet_length(F.to_json(F.struct("*"))) + F.lit(32)
    return df.agg(F.sum(row)).first()[0] or 0


def sent(df: DataFrame) -> DataFrame:
    """Broadcast a stored or otherwise cheap table that is measured to be small, so that the rows that meet it stay where they are."""
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df


def salted_lookup(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    rows: str,
    spread: list[str],
    how: str = "inner",
    most: int | None = None,
    hot_rows: int = HOT_ROWS,
    small_spread: list[str] | None = None,
    owners: DataFrame | None = None,
) -> DataFrame:
    """Join ``big`` to ``small`` on ``keys``; ``small[rows]`` tells how many ``big`` rows a key owns.

    A key makes (rows of ``big``) x (rows of ``small``) rows. Above ``hot_rows`` it is dealt to a grid:
    ``big`` by a hash of ``spread``, ``small`` (where it has several rows per key) by one of
    ``small_spread``, each repeated along the other side. Cold keys are not repeated. A left join
    needs one row per key in ``small``. A caller that knows the ``most`` rows any key can make
    spares the look for hot keys; one whose ``small`` has one row per key may give its ``owners``, a cheaper
    table of the keys and their ``rows``. Nothing runs while the plan is built.
    """
    if most is not None and most <= hot_rows:
        return big.join(small, keys, how)
    if owners is not None:
        owned = owners.select(*keys, F.col(rows).alias("_owned"), F.lit(1).alias("_fan"))
    else:
        owned = small.groupBy(*keys).agg(F.max(rows).alias("_owned"), F.count(F.lit(1)).alias("_fan"))
    made = F.col("_owned").cast("double") * F.col("_fan")
    cells = F.ceil(made / F.lit(hot_rows))
    hot = (
        owned.where(made > hot_rows)
        .orderBy(F.desc(made), *keys)
        .limit(SPREAD_KEYS)  # the list only shapes the plan, rows of all other keys are joined as well
        .select(*keys, F.least(cells, F.col("_owned")).cast("int").alias("_a"), cells.alias("_cells"))
        .select(*keys, "_a", F.ceil(F.col("_cells") / F.col("_a")).cast("int").alias("_b"))
    )
    if how != "inner" or small_spread is None:
        hot = hot.withColumn("_b", F.lit(1))
    hot = F.broadcast(hot)

    def dealt(df: DataFrame, by: list[str] | None, own: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64(*by), F.col(own).cast("long")).cast("int") if by else F.lit(0)
        repeats = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
        marked = df.join(hot, keys, "left").withColumn(f"{own}_at", F.when(F.col(own).isNull(), F.lit(0)).otherwise(place))
        return marked.withColumn(f"{other}_at", F.explode(repeats)).drop("_a", "_b")

    at = [*keys, "_a_at", "_b_at"]
    return dealt(big, spread, "_a", "_b").join(dealt(small, small_spread, "_b", "_a"), at, how).drop("_a_at", "_b_at")


class HotGroups(NamedTuple):
    groups: DataFrame  # keys, group_rows
    count: int
    rows: int  # of the hot groups
    all_rows: int
    bytes: int  # of the hot groups' keys

    def listed(self, *columns: str) -> DataFrame:
        """The hot groups, to be broadcast where they are small enough."""
        found = self.groups.select(*columns) if columns else self.groups
        return F.broadcast(found) if self.bytes + 16 * self.count <= BROADCAST_BYTES else found


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, weight: Column | None = None) -> HotGroups:
    """Groups of more than ``hot_rows`` rows (or that much ``weight`` in all), their number and sizes."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sizes = df.groupBy(*keys).agg(size.cast("long").alias("group_rows"))
    large = F.col("group_rows") > hot_rows
    length = sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys), F.lit(0))
    found = sizes.agg(
        F.count_if(large).alias("count"),
        F.sum(F.when(large, F.col("group_rows"))).alias("rows"),
        F.sum("group_rows").alias("all"),
        F.sum(F.when(large, length)).alias("bytes"),
    ).first()
    return HotGroups(sizes.where(large), found["count"], found["rows"] or 0, found["all"] or 0, found["bytes"] or 0)


def place(df: DataFrame, keys: list[str], rows: int, rows_per_task: int) -> DataFrame:
    """Shuffle rows that fan out later to their group.

    The number of partitions is explicit because adaptive coalescing sees only the compact
    rows and would put far too much of what they expand to into one task. It differs from
    the session's number, or Spark would merge this shuffle into an earlier one on the same
    keys, which may be coalesced.
    """
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(2 * configured, math.ceil(rows / rows_per_task)), *keys)


def ordered_chunks(
    df: DataFrame, keys: list[str], order: list[Column], hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, bool]:
    """Add ``chunk``: 0 for ordinary groups, an order-preserving number for hot ones.

    Hot rows are range partitioned by group and order, so every chunk holds about
    ``hot_rows`` rows however a group is shaped. Range bounds come from a sample and
    may differ between two evaluations, so the cut is written out once.
    """
    hot = hot_groups(df, keys, hot_rows)
    if hot.count == 0:
        return df.withColumn("chunk", F.lit(0)), False
    hot_keys = hot.listed(*keys)
    pieces = max(2, math.ceil(hot.rows / hot_rows))
    cut = (
        df.join(hot_keys, keys, "left_semi")
        .repartitionByRange(pieces, *keys, *order)
        .withColumn("chunk", F.spark_partition_id())
    )
    rest = df.join(hot_keys, keys, "left_anti").withColumn("chunk", F.lit(0))
    return rest.unionByName(durable(cut)), True


def rank_in_group(
    df: DataFrame, keys: list[str], order: list[Column], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``position`` (1-based, in ``order``) and ``group_rows``."""
    chunked, split = ordered_chunks(df, keys, order, hot_rows)
    parts = [*keys, "chunk"]
    ranked = chunked.withColumn(
        "position", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)).cast("long")
    ).withColumn("group_rows", F.count(F.lit(1)).over(Window.partitionBy(*parts)))
    if not split:
        return ranked.drop("chunk")
    # one row per chunk: as many as range partitions, plus one per ordinary group
    sizes = chunked.groupBy(*parts).agg(F.count(F.lit(1)).alias("chunk_rows"))
    by_chunk = Window.partitionBy(*keys).orderBy("chunk")
    offsets = sizes.select(
        *parts,
        F.coalesce(
            F.sum("chunk_rows").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("chunk_rows").over(Window.partitionBy(*keys)).alias("_all"),
    )
    return (
        ranked.join(offsets, parts)
        .withColumn("position", F.col("position") + F.col("_before"))
        .withColumn("group_rows", F.col("_all"))
        .drop("_before", "_all", "chunk")
    )
