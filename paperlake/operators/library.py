"""Libraries: listings, look-ups, counts, statistics, paging.

Input ``saved`` has the stored layout of ``sources.schemas.SAVED_PAPERS`` (lists as
arrays or as encoded text). One library is a filter on the result of any of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from paperlake.constants import (
    PAPERS_PER_PAGE,
    PAPER_KEY,
    STATUSES,
    SUGGESTIONS,
    TENANT,
    TOP_CATEGORIES,
)
from paperlake.functions.display import row_fields
from paperlake.functions.lists import as_list
from paperlake.functions.text import date_part, strip, truncate
from paperlake.operators.lookup import GramIndex, find, gram_index
from paperlake.operators.skew import HOT_ROWS, rank_in_group

CORPUS_COLUMNS = [
    "paper_id", "title", "authors", "summary", "published", "categories", "arxiv_url", "pdf_url", "doi",
]


def newest_first(instant: str = "saved_at", tie: str = "paper_id") -> list[Column]:
    return [F.col(instant).desc(), F.col(tie).asc()]


def list_column(df: DataFrame, name: str) -> Column:
    return as_list(F.col(name), isinstance(df.schema[name].dataType, ArrayType))


def normalise_papers(df: DataFrame) -> DataFrame:
    """Decode the list columns and turn absent optional text into empty text."""
    optional = [c for c in ("summary", "published", "updated", "pdf_url", "doi") if c in df.columns]
    return df.withColumns(
        {
            "authors": list_column(df, "authors"),
            "categories": list_column(df, "categories"),
            **{c: F.coalesce(F.col(c), F.lit("")) for c in optional},
        }
    )


def listing(saved: DataFrame) -> DataFrame:
    """Saved papers with decoded lists; the note stays NULL where there is none."""
    return normalise_papers(saved).select(*TENANT, *CORPUS_COLUMNS, "status", "note", "saved_at")


def in_listing_order(df: DataFrame) -> DataFrame:
    """Order for a reader: of one library (``for_tenant``) or of rows without texts, since a sort moves whole rows."""
    return df.orderBy(*TENANT, *newest_first())


def corpus(saved: DataFrame) -> DataFrame:
    """What similarity reads of a library."""
    return normalise_papers(saved).select(*TENANT, *CORPUS_COLUMNS)


def for_tenant(df: DataFrame, user_id: str, guild_id: str = "") -> DataFrame:
    return df.where((F.col("user_id") == user_id) & (F.col("guild_id") == guild_id))


def by_status(saved: DataFrame, status: str) -> DataFrame:
    """Listing of one status; an unknown status is simply empty."""
    return listing(saved.where(F.col("status") == status))


def _asked(requests: DataFrame) -> DataFrame:
    """Different papers asked for; white space around an id does not count."""
    return requests.select(*TENANT, strip(F.col("paper_id")).alias("paper_id")).distinct()


def paper_exists(requests: DataFrame, saved: DataFrame) -> DataFrame:
    """Flag per requested user_id, guild_id, paper_id."""
    flags = saved.select(*PAPER_KEY, F.lit(True).alias("saved"))
    return (
        _asked(requests)
        .join(flags, PAPER_KEY, "left")
        .withColumn("saved", F.coalesce(F.col("saved"), F.lit(False)))
    )


def notes(requests: DataFrame, saved: DataFrame) -> DataFrame:
    """Note per request: NULL where not saved, empty where saved without one; plus its state."""
    held = saved.select(*PAPER_KEY, F.lit(True).alias("_saved"), "note")
    note = F.when(F.col("_saved"), F.coalesce(F.col("note"), F.lit("")))
    state = F.when(note.isNull(), "not_saved").when(note == "", "no_note").otherwise("note")
    return (
        _asked(requests)
        .join(held, PAPER_KEY, "left")
        .select(*PAPER_KEY, note.alias("note"), state.alias("state"))
    )


def suggest(
    requests: DataFrame, items: DataFrame, column: str, order: list[Column], limit: int = SUGGESTIONS, index: GramIndex | None = None
) -> DataFrame:
    """First ``limit`` items that contain the needle, ignoring case; an empty needle keeps all.

    ``requests``: user_id, guild_id, needle. ``index`` (``gram_index`` of the items) spares each batch the look at all items.
    """
    return find(requests, index or gram_index(items, column, order, limit), column, limit)


def paper_id_index(saved: DataFrame) -> GramIndex:
    return gram_index(saved.select(*PAPER_KEY, "saved_at"), "paper_id", newest_first())


def suggest_paper_ids(requests: DataFrame, saved: DataFrame, index: GramIndex | None = None) -> DataFrame:
    return suggest(requests, saved.select(*PAPER_KEY, "saved_at"), "paper_id", newest_first(), index=index)


def paper_ids(saved: DataFrame) -> DataFrame:
    """Paper ids, newest first within each library."""
    return in_listing_order(saved.select(*PAPER_KEY, "saved_at"))


def sizes(saved: DataFrame, tenants: DataFrame) -> DataFrame:
    """Library size for each tenant asked for; 0 where nothing is saved."""
    counted = saved.groupBy(*TENANT).agg(F.count(F.lit(1)).alias("total"))
    return (
        tenants.select(*TENANT)
        .distinct()
        .join(counted, TENANT, "left")
        .withColumn("total", F.coalesce(F.col("total"), F.lit(0)))
    )


def status_counts(saved: DataFrame) -> DataFrame:
    return saved.groupBy(*TENANT, "status").agg(F.count(F.lit(1)).alias("papers"))


def _status_columns() -> list[Column]:
    return [F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in STATUSES]


def status_counts_filled(saved: DataFrame) -> DataFrame:
    """One column per status in the fixed order, zero where there is none."""
    return saved.groupBy(*TENANT).agg(*_status_columns())


def category_counts(saved: DataFrame) -> DataFrame:
    """How often each category occurs; a repeat inside one paper counts again."""
    return (
        saved.select(*TENANT, F.explode(list_column(saved, "categories")).alias("category"))
        .groupBy(*TENANT, "category")
        .agg(F.count(F.lit(1)).alias("papers"))
    )


def top_categories(saved: DataFrame, top: int = TOP_CATEGORIES) -> DataFrame:
    best = Window.partitionBy(*TENANT).orderBy(F.desc("papers"), "category")
    return (
        category_counts(saved)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
    )


def stats(saved: DataFrame, collections: DataFrame) -> DataFrame:
    """Totals, status counts, collection count and top categories per tenant.

    Tenants with only collections are kept; every joined side is already one row per tenant.
    """
    counts = saved.groupBy(*TENANT).agg(F.count(F.lit(1)).alias("total"), *_status_columns())
    named = collections.groupBy(*TENANT).agg(F.count(F.lit(1)).alias("collections_count"))
    top = (
        top_categories(saved)
        .groupBy(*TENANT)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "category", "papers"))).alias("_top"))
        .select(*TENANT, F.transform("_top", lambda x: F.struct(x["category"], x["papers"])).alias("top_categories"))
    )
    zeros = ["total", *[s.replace("-", "_") for s in STATUSES], "collections_count"]
    joined = counts.join(named, TENANT, "full").join(top, TENANT, "left").fillna(0, subset=zeros)
    none = F.array().cast(top.schema["top_categories"].dataType)
    return joined.withColumn("top_categories", F.coalesce("top_categories", none))


def pages(saved: DataFrame, per_page: int = PAPERS_PER_PAGE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Global 1-based index, page and page count of every saved paper."""
    ranked = rank_in_group(saved.select(*PAPER_KEY, "saved_at"), TENANT, newest_first(), hot_rows)
    return page_numbers(ranked, per_page)


def page_numbers(ranked: DataFrame, per_page: int) -> DataFrame:
    return ranked.withColumns(
        {
            "page": F.ceil(F.col("position") / F.lit(per_page)),
            "total_pages": F.greatest(F.lit(1).cast("long"), F.ceil(F.col("group_rows") / F.lit(per_page))),
        }
    ).withColumnsRenamed({"position": "idx", "group_rows": "total"})


def cards(saved: DataFrame) -> DataFrame:
    """Fields of a library row."""
    note = F.when(F.coalesce(F.col("note"), F.lit("")) != "", truncate(F.col("note"), 100))
    return normalise_papers(saved).select(
        *PAPER_KEY,
        "status",
        *[value.alias(name) for name, value in row_fields().items()],
        date_part(F.date_format("saved_at", "yyyy-MM-dd")).alias("saved_date"),
        note.alias("note_line"),
    )
