"""Row fields of the listings, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.constants import LINK_GAP, NO_ABSTRACT, PAGE_LABEL, PDF_LABEL, UNKNOWN
from paperlake.functions.lists import first_or, format_authors, format_categories
from paperlake.functions.text import date_part, quick_summary, truncate


def _c(name: str) -> Column:
    return F.col(name)


def row_fields(authors: int = 2, categories: int = 2) -> dict[str, Column]:
    """Fields shared by every listing row."""
    return {
        "title_line": truncate(_c("title"), 200),
        "authors_line": format_authors(_c("authors"), authors),
        "published_date": date_part(_c("published")),
        "categories_line": format_categories(_c("categories"), categories),
    }


def links(link: str = PAGE_LABEL, pdf: str = PDF_LABEL) -> Column:
    """Link line; the pdf part appears only where there is a pdf."""
    page = F.concat(F.lit(f"[{link}]("), _c("arxiv_url"), F.lit(")"))
    tail = F.concat(F.lit(f"{LINK_GAP}[{pdf}]("), _c("pdf_url"), F.lit(")"))
    return F.concat(page, F.when(F.coalesce(_c("pdf_url"), F.lit("")) == "", F.lit("")).otherwise(tail))


def search_line() -> dict[str, Column]:
    """Name and value of a search result line; their lengths count in the budget."""
    fields = row_fields()
    value = F.concat_ws(
        "\n",
        F.concat(
            fields["authors_line"], F.lit("  •  "), fields["published_date"],
            F.lit("  •  `"), fields["categories_line"], F.lit("`"),
        ),
        truncate(_c("summary"), 120),
        links(),
    )
    return {
        "line_name": F.concat(F.lit("`"), _c("rank").cast("string"), F.lit("` "), fields["title_line"]),
        "line_value": truncate(value, 1024),
    }


def detail_fields() -> dict[str, Column]:
    abstract = F.when(F.coalesce(_c("summary"), F.lit("")) == "", F.lit(NO_ABSTRACT)).otherwise(_c("summary"))
    return {
        "title_line": truncate(_c("title"), 256),
        "authors_line": truncate(format_authors(_c("authors"), 8), 1024),
        "published_date": date_part(_c("published")),
        "categories_line": truncate(format_categories(_c("categories"), 6), 1024),
        "doi_url": F.when(
            F.coalesce(_c("doi"), F.lit("")) != "", F.concat(F.lit("https://doi.org/"), _c("doi"))
        ),
        "quick_summary": truncate(quick_summary(abstract), 1024),
        "abstract": truncate(abstract, 1024),
    }


def select_option() -> dict[str, Column]:
    return {
        "label": truncate(_c("title"), 100),
        "description": truncate(
            F.concat(date_part(_c("published")), F.lit(" • "), first_or(_c("authors"), UNKNOWN)), 100
        ),
    }
