"""Substring look-up inside every tenant, through an index of short pieces of the items.

A *gram* is a piece of up to ``GRAM`` characters of an item in lower case. An item with a needle of that length or less is
one of the gram's items, so the gram's first items are the answer. A longer needle is looked for among the items of its
rarest gram only, and a needle with a gram that no item has is not looked for at all. So the rows looked at follow the hits, not
the number of items times that of needles.

A gram's items are kept in the order of the answer, in blocks of ``BLOCK``. A long needle opens the first block; only where
that gives too few hits are the others opened.

A tenant with no more items than a block holds has no grams: to look at its items costs what opening a block costs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.constants import SUGGESTIONS, TENANT
from paperlake.operators.skew import HOT_ROWS, rank_in_group, salted_lookup
from paperlake.runtime import durable

GRAM = 3
BLOCK = 128
#: Requests that are sent to every part of the index. A stored index is too well compressed for its size in files to tell
#: whether it could be sent instead, so with more requests both sides are dealt by key.
FEW = 10_000


class GramIndex(NamedTuple):
    """``stored`` it by writing its tables and reading them back."""

    heads: DataFrame  # tenant, gram (0 to GRAM characters), rows: its first items
    postings: DataFrame  # tenant, gram (GRAM characters), block, df (items of the gram), rows: items in order
    small: DataFrame  # tenant of up to BLOCK items, rows: all its items in order


def _grams(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters."""
    at = F.sequence(F.lit(1), F.length(text) - (size - 1))
    pieces = F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(size))))
    return F.when(F.length(text) >= size, pieces).otherwise(F.array().cast("array<string>"))


def gram_index(items: DataFrame, column: str, order: list[Column], limit: int = SUGGESTIONS, hot_rows: int = HOT_ROWS) -> GramIndex:
    """Index of the items of every tenant, to be answered in ``order``."""
    ranked = rank_in_group(items.where(F.col(column).isNotNull()), TENANT, order, hot_rows)
    columns = [*TENANT, "position", "group_rows", F.col(column).alias("item"), F.lower(column).alias("folded")]
    every = durable(ranked.select(*columns), "gram-items")
    placed = every.where(F.col("group_rows") > BLOCK)
    key = [*TENANT, "gram"]
    listed = lambda: F.transform(F.sort_array(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("rows")
    few = every.where(F.col("group_rows") <= BLOCK).select(*TENANT, F.col("position").alias("place"), "item")

    pieces = F.concat(F.array(F.lit("")), *[_grams(F.col("folded"), size) for size in range(1, GRAM)])
    short = placed.select(*TENANT, F.explode(pieces).alias("gram"), F.col("position").alias("place"), "item")
    # the bound lets every partition keep its first items before they are shuffled
    first = short.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("place"))).where(F.col("_n") <= limit)

    whole = placed.select(*TENANT, F.explode(_grams(F.col("folded"), GRAM)).alias("gram"), F.col("position").alias("place"), "item")
    blocks = rank_in_group(whole, key, [F.col("place")], hot_rows)
    postings = durable(
        blocks.groupBy(*key, F.col("group_rows").alias("df"), F.expr(f"(position - 1) div {BLOCK}").alias("block")).agg(listed()), "gram-postings"
    )
    heads = postings.where("block = 0").select(*key, F.slice("rows", 1, limit).alias("rows"))
    return GramIndex(first.groupBy(*key).agg(listed()).unionByName(heads), postings, few.groupBy(*TENANT).agg(listed()))


def find(requests: DataFrame, index: GramIndex, column: str, limit: int = SUGGESTIONS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The first ``limit`` items that contain the needle, ignoring case: tenant, needle, ``column``, position.

    ``requests``: user_id, guild_id, needle. An empty needle finds all items, a null one none. At most as many items as the index's heads hold.
    """
    asked = requests.select(*TENANT, "needle", F.lower("needle").alias("folded")).where("needle is not null").distinct()
    asked = durable(asked, "gram-asked")
    few = asked.count() <= FEW

    def met(some: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        if few:
            return (F.broadcast(some) if how == "inner" else some).join(table, keys, how)
        return some.join(table.hint("merge"), keys, how)

    size = F.length("folded")
    whole = met(asked, index.small, TENANT).withColumn("rows", F.filter("rows", lambda item: F.contains(F.lower(item), F.col("folded"))))
    short = met(asked.where(size <= GRAM).withColumnRenamed("folded", "gram"), index.heads, [*TENANT, "gram"])
    short = short.select(*TENANT, "needle", "rows").unionByName(whole.select(*TENANT, "needle", "rows"))
    told = short.select(*TENANT, "needle", F.posexplode(F.slice("rows", 1, limit)).alias("position", "item"))
    told = told.select(*TENANT, "needle", "item", (F.col("position") + 1).alias("position"))

    known = index.postings.where("block = 0").select(*TENANT, "gram", "df")
    pieces = asked.where(size > GRAM).select("*", F.explode(_grams(F.col("folded"), GRAM)).alias("gram"))
    rarest = (
        met(pieces, known, [*TENANT, "gram"], "left")
        .groupBy(*TENANT, "needle", "folded")
        .agg(F.min(F.struct("df", "gram")).alias("least"), F.count_if(F.col("df").isNull()).alias("unknown"))
        .where("unknown = 0")
        .select(*TENANT, "needle", "folded", "least.df", "least.gram")
    )
    rarest = durable(rarest, "gram-needles")
    first = durable(_hits(met(rarest, index.postings.where("block = 0").drop("df"), [*TENANT, "gram"])), "gram-hits")
    short_of = rarest.where(F.col("df") > BLOCK).join(
        first.groupBy(*TENANT, "needle").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= limit), [*TENANT, "needle"], "left_anti"
    )
    found = first
    if not short_of.isEmpty():
        blocks = index.postings.where("block > 0").drop("df")
        found = first.unionByName(_hits(salted_lookup(blocks, short_of, [*TENANT, "gram"], "df", ["block"], hot_rows=hot_rows, small_spread=["needle"])))
    best = Window.partitionBy(*TENANT, "needle").orderBy("block", "place")
    found = found.withColumn("position", F.row_number().over(best)).where(F.col("position") <= limit)
    return told.unionByName(found.select(*TENANT, "needle", "item", "position")).withColumnRenamed("item", column)


def _hits(opened: DataFrame) -> DataFrame:
    """Items of opened blocks that contain the needle."""
    rows = opened.select(*TENANT, "needle", "folded", "block", F.posexplode("rows").alias("place", "item"))
    return rows.where(F.contains(F.lower("item"), F.col("folded"))).drop("folded")
