"""Order-statistic index over the rows of every group: a page is found by counts, and its chunk alone is read.

The rows of a group lie in order in chunks of at most ``CHUNK``. Next to them the counts say how many rows are
before each chunk, so a page is a range of positions, the counts name the one or two chunks that hold it, and
those are read by their number. The counts are a thousandth of the rows. Both tables are sorted by group and
chunk, so a reader of one page skips what lies beside it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlake.constants import PAPERS_PER_PAGE
from paperlake.operators.skew import HOT_ROWS, rank_in_group
from paperlake.runtime import durable

CHUNK = 1024


class PageIndex(NamedTuple):
    keys: list[str]
    size: int  # rows of a chunk at most
    counts: DataFrame  # keys, chunk, n, before (rows of the group in earlier chunks), total
    chunks: DataFrame  # keys, chunk, rows: structs in order


def page_index(rows: DataFrame, keys: list[str], order: list[Column], size: int = CHUNK, hot_rows: int = HOT_ROWS) -> PageIndex:
    """Index of ``rows`` in ``order`` within ``keys``. A group may hold any part of the rows.

    ``order`` must tell all rows of a group apart, or pages may share rows differently when built anew.
    """
    rest = [c for c in rows.columns if c not in keys]
    ranked = rank_in_group(rows, keys, order, hot_rows)
    own = ranked.select(*keys, F.expr(f"(position - 1) div {size}").alias("chunk"), "position", F.struct(*rest).alias("item"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("position", "item"))), lambda x: x["item"])
    chunks = durable(_laid_out(own.groupBy(*keys, "chunk").agg(listed.alias("rows")), keys), "page-chunks")
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        chunks.select(*keys, "chunk", F.size("rows").cast("long").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    )
    return PageIndex(keys, size, durable(_laid_out(counts, keys), "page-counts"), chunks)


def _laid_out(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartitionByRange(*keys, "chunk").sortWithinPartitions(*keys, "chunk")


def store(index: PageIndex, path: str) -> None:
    """Write both tables below ``path``; the rows keep the order of the index."""
    for name in ("chunks", "counts"):
        _laid_out(getattr(index, name), index.keys).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def stored(spark: SparkSession, path: str, keys: list[str], size: int = CHUNK) -> PageIndex:
    read = lambda name: spark.read.parquet(f"{path.rstrip('/')}/{name}")
    return PageIndex(keys, size, read("counts"), read("chunks"))


def _numbered(opened: DataFrame, keys: list[str], per_page: int) -> DataFrame:
    """Rows of the asked ``page`` out of opened chunks, with idx, total, page and total_pages."""
    rows = opened.select(*keys, "page", "total", "before", F.posexplode("rows").alias("_at", "_item"))
    rows = rows.withColumn("idx", F.col("before") + F.col("_at") + 1)
    rows = rows.where(F.expr(f"(idx - 1) div {per_page} + 1") == F.col("page"))
    return rows.select(*keys, "_item.*", "idx", "total", "page", F.ceil(F.col("total") / F.lit(per_page)).alias("total_pages"))


def find_pages(requests: DataFrame, index: PageIndex, per_page: int = PAPERS_PER_PAGE) -> DataFrame:
    """Rows of the asked pages (``requests``: keys, page from 1). A page that does not exist has none.

    Counts are met by (keys, stretch of positions), a stretch being as long as a chunk, so many requests to one
    large group are not compared with all its chunks.
    """
    keys, size = index.keys, index.size
    asked = requests.select(*keys, F.col("page").cast("long").alias("page")).where("page >= 1").distinct()
    first, last = f"(page - 1) * {per_page}", f"page * {per_page} - 1"
    asked = asked.select("*", F.explode(F.expr(f"sequence(({first}) div {size}, ({last}) div {size})")).alias("stretch"))
    spans = index.counts.select("*", F.explode(F.expr(f"sequence(before div {size}, (before + n - 1) div {size})")).alias("stretch"))
    overlap = (F.col("before") <= F.expr(last)) & (F.col("before") + F.col("n") > F.expr(first))
    located = asked.join(spans, [*keys, "stretch"]).where(overlap).select(*keys, "chunk", "page", "total", "before").distinct()
    return _numbered(located.join(index.chunks, [*keys, "chunk"]), keys, per_page)


def one_page(index: PageIndex, group: dict[str, str], page: int, per_page: int = PAPERS_PER_PAGE) -> DataFrame:
    """One page of one group: its counts are looked up, then only the chunks that hold the page are read."""
    own = F.lit(True)
    for key in index.keys:
        own = own & (F.col(key) == group[key])
    holds = (F.col("before") < page * per_page) & (F.col("before") + F.col("n") > (page - 1) * per_page)
    places = index.counts.where(own & holds).select("chunk", "before", "total").collect()  # those of one page
    opened = index.chunks.where(own & F.col("chunk").isin([p["chunk"] for p in places]))
    before, total = F.lit(None).cast("long"), places[0]["total"] if places else 0
    for place in places:
        before = F.when(F.col("chunk") == place["chunk"], F.lit(place["before"])).otherwise(before)
    return _numbered(opened.withColumns({"page": F.lit(page).cast("long"), "total": F.lit(total).cast("long"), "before": before}), index.keys, per_page)
