"""Named collections: counts, contents, states, paging and citation export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.constants import (
    COLLECTION_KEY,
    COLLECTION_VIEW_ROWS,
    COLLECTIONS_PER_PAGE,
    PAPER_KEY,
    TENANT,
)
from paperlake.functions.citations import cite, delivery, fence_tag, file_extension
from paperlake.functions.display import row_fields
from paperlake.functions.text import date_part, strip
from paperlake.operators.library import (
    list_column,
    newest_first,
    normalise_papers,
    page_numbers,
    suggest,
)
from paperlake.operators.lookup import GramIndex, gram_index
from paperlake.operators.skew import HOT_ROWS, rank_in_group


def counts(collections: DataFrame, memberships: DataFrame) -> DataFrame:
    """Collections with their paper counts, empty ones included.

    Memberships are counted before the join, so a large collection reaches it as one row.
    """
    sized = memberships.groupBy(F.col("collection_id").alias("id")).agg(
        F.count("paper_id").alias("paper_count")
    )
    return (
        collections.select("id", *COLLECTION_KEY, "created_at")
        .join(sized, "id", "left")
        .withColumn("paper_count", F.coalesce(F.col("paper_count"), F.lit(0)))
    )


def papers(memberships: DataFrame, saved: DataFrame) -> DataFrame:
    """Papers of every collection; a membership whose paper is no longer saved vanishes."""
    rows = saved.withColumns(
        {"authors": list_column(saved, "authors"), "categories": list_column(saved, "categories")}
    ).select(
        *PAPER_KEY, "title", "authors", "summary", "published", "categories",
        "arxiv_url", "pdf_url", "doi", "status", "note",
    )
    return members(memberships, rows)


def decoded(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: list_column(rows, c) for c in ("authors", "categories")})


def members(memberships: DataFrame, saved: DataFrame) -> DataFrame:
    """Memberships with the other columns of ``saved``, which may be without the paper's own columns."""
    return memberships.select("collection_id", *PAPER_KEY, "added_at").join(saved, PAPER_KEY)


def in_view_order(df: DataFrame) -> DataFrame:
    return df.orderBy("collection_id", *newest_first("added_at"))


def states(requests: DataFrame, collections: DataFrame, memberships: DataFrame, saved: DataFrame) -> DataFrame:
    """missing, empty or ok per requested user_id, guild_id, name."""
    held = (
        memberships.select("collection_id", *PAPER_KEY)
        .join(saved.select(*PAPER_KEY), PAPER_KEY, "left_semi")
        .groupBy(F.col("collection_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("papers"))
    )
    wanted = requests.select(*TENANT, strip(F.col("name")).alias("name")).distinct()
    # collections and their papers first: missing ones would all meet under one empty id
    known = collections.select("id", *COLLECTION_KEY).join(held, "id", "left")
    return (
        wanted.join(known, COLLECTION_KEY, "left")
        .select(
            *COLLECTION_KEY,
            F.when(F.col("id").isNull(), "missing")
            .when(F.col("papers").isNull(), "empty")
            .otherwise("ok")
            .alias("state"),
            F.coalesce(F.col("papers"), F.lit(0)).alias("papers"),
        )
    )


def names(collections: DataFrame) -> DataFrame:
    return collections.select(*COLLECTION_KEY).orderBy(*COLLECTION_KEY)


def name_index(collections: DataFrame) -> GramIndex:
    return gram_index(collections.select(*COLLECTION_KEY), "name", [F.col("name").asc()])


def suggest_names(requests: DataFrame, collections: DataFrame, index: GramIndex | None = None) -> DataFrame:
    return suggest(requests, collections.select(*COLLECTION_KEY), "name", [F.col("name").asc()], index=index)


def pages(
    collections: DataFrame, memberships: DataFrame, per_page: int = COLLECTIONS_PER_PAGE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Collection rows with paper count, created date and page."""
    ranked = rank_in_group(
        counts(collections, memberships), TENANT, newest_first("created_at", "id"), hot_rows
    )
    return page_numbers(ranked, per_page).withColumn(
        "created", date_part(F.date_format("created_at", "yyyy-MM-dd"))
    )


def head(contents: DataFrame, rows: int = COLLECTION_VIEW_ROWS) -> DataFrame:
    """First rows of each collection with the number of papers in it.

    The count is a separate aggregate: a window count would need the whole collection in one task.
    """
    total = contents.groupBy("collection_id").agg(F.count(F.lit(1)).alias("total"))
    newest = Window.partitionBy("collection_id").orderBy(*newest_first("added_at"))
    fields = row_fields()
    return (
        contents.withColumn("position", F.row_number().over(newest))
        .where(F.col("position") <= rows)
        .join(total, "collection_id")
        .select(
            "collection_id", *PAPER_KEY, "position", "total", "status",
            *[fields[name].alias(name) for name in ("title_line", "authors_line", "published_date")],
        )
    )


# --- export ------------------------------------------------------------------


def citations(contents: DataFrame, collections: DataFrame, fmt: str) -> DataFrame:
    """One citation per collection paper, with the collection's key."""
    named = collections.select(F.col("id").alias("collection_id"), "name")
    return (
        normalise_papers(contents)
        .select("collection_id", *PAPER_KEY, "added_at", cite(fmt).alias("citation"))
        .join(named, "collection_id")
        .withColumn("format", F.lit(fmt))
    )


def _heading() -> Column:
    return F.concat(
        F.lit("**"), F.col("papers").cast("string"), F.lit("** citations from **"), F.col("name"), F.lit("**")
    )


def paper_citations(papers: DataFrame, fmt: str) -> DataFrame:
    """One citation per paper, for collections whose members come without texts."""
    return normalise_papers(papers).select("paper_id", cite(fmt).alias("citation"))


def named_members(contents: DataFrame, collections: DataFrame, fmt: str) -> DataFrame:
    """Collection papers with the collection's name: ``citations`` without the text."""
    named = collections.select(F.col("id").alias("collection_id"), "name")
    return (
        contents.select("collection_id", *PAPER_KEY, "added_at")
        .join(named, "collection_id")
        .withColumn("format", F.lit(fmt))
    )


def export_summary(cited: DataFrame, length: Column | None = None) -> DataFrame:
    """Per collection: number of papers, length of the joined text and how it is delivered.

    Lengths add up, so the joined text itself is never built here.
    """
    length = F.length("citation") if length is None else length
    joined = F.col("text_length") + 2 * (F.col("papers") - 1)
    heading = _heading()
    return (
        cited.groupBy("collection_id", *COLLECTION_KEY, "format")
        .agg(F.count(F.lit(1)).alias("papers"), F.sum(length).alias("text_length"))
        .withColumn("text_length", joined)
        .withColumn("heading", heading)
        .withColumn(
            "delivery",
            delivery(F.col("text_length") + F.length("heading") + F.length(fence_tag(F.col("format"))) + 8),
        )
        .withColumn("file_name", F.concat(F.col("name"), F.lit("."), file_extension(F.col("format"))))
    )


def export_inline(cited: DataFrame, summary: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Joined citations of the collections that fit a message, newest-added first.

    Only collections below the inline limit are gathered, so a row never exceeds it.
    """
    fits = summary.where(F.col("delivery") == "inline").select("collection_id")
    newest = F.sort_array(
        F.collect_list(F.struct(-F.unix_micros(F.col("added_at").cast("timestamp")), "paper_id", "citation"))
    )
    short = cited.join(fits, "collection_id", "left_semi")
    if texts is not None:
        short = short.select("collection_id", "added_at", "paper_id").join(texts, "paper_id")
    return (
        short.groupBy("collection_id")
        .agg(F.array_join(F.transform(newest, lambda x: x["citation"]), "\n\n").alias("text"))
    )


def export(cited: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Delivery of each collection; the text is present where it is sent inline.

    ``texts`` (``paper_citations``) serves ``named_members``, which have none: only its lengths meet all members, and
    citations only those that are sent inline.
    """
    if texts is None:
        summary = export_summary(cited)
    else:
        lengths = texts.select("paper_id", F.length("citation").alias("length"))
        summary = export_summary(cited.join(lengths, "paper_id"), F.col("length"))
    tag = fence_tag(F.col("format"))
    payload = F.concat(F.col("heading"), F.lit("\n```"), tag, F.lit("\n"), F.col("text"), F.lit("\n```"))
    return (
        summary.join(export_inline(cited, summary, texts), "collection_id", "left")
        .withColumn("payload", payload)
        .drop("text", "heading")
    )


def export_lines(cited: DataFrame, hot_rows: int = HOT_ROWS, texts: DataFrame | None = None) -> DataFrame:
    """Lines of the export files: one citation per row in file order.

    ``texts`` (``paper_citations``) serves ``named_members``, which have none: they come to the numbered lines.

    Every citation but the last is followed by an empty line, so the written text is
    the citations joined by a blank line, however many part files it spans.
    """
    ranked = rank_in_group(
        cited.withColumn("file_name", F.concat(F.col("name"), F.lit("."), file_extension(F.col("format")))),
        ["collection_id"],
        newest_first("added_at"),
        hot_rows,
    )
    if texts is not None:
        ranked = ranked.join(texts, "paper_id")
    last = F.col("position") == F.col("group_rows")
    return ranked.select(
        *TENANT,
        "collection_id",
        "file_name",
        "position",
        F.when(last, F.col("citation")).otherwise(F.concat(F.col("citation"), F.lit("\n"))).alias("text"),
    )


