"""Atom feeds: landed files or entry text to paper records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions.ids import extract_paper_id
from paperlake.functions.text import clean_text
from paperlake.sources.schemas import ATOM_ENTRY

XML_OPTIONS = {"ignoreNamespace": "true", "mode": "FAILFAST", "ignoreSurroundingSpaces": "false"}


def _or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _present(items: Column, field: str) -> Column:
    """Values of ``field`` over an array of structs, without the absent ones."""
    values = F.transform(items, lambda item: item[field])
    kept = F.filter(values, lambda v: _or_empty(v) != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def papers_from_entries(entries: DataFrame, prefix: str = "") -> DataFrame:
    """Map raw entries (schema ``ATOM_ENTRY``) to paper records."""
    def raw(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    pdf_links = F.filter(raw("link"), lambda link: link["_title"] == "pdf")
    return entries.select(
        extract_paper_id(_or_empty(raw("id"))).alias("paper_id"),
        clean_text(raw("title")).alias("title"),
        _present(raw("author"), "name").alias("authors"),
        clean_text(raw("summary")).alias("summary"),
        _or_empty(raw("published")).alias("published"),
        _or_empty(raw("updated")).alias("updated"),
        _present(raw("category"), "_term").alias("categories"),
        _or_empty(raw("id")).alias("arxiv_url"),
        _or_empty(F.try_element_at(pdf_links, F.lit(1))["_href"]).alias("pdf_url"),
        _or_empty(raw("doi")).alias("doi"),
    )


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Papers of all feed files under ``path``; a malformed file is an error."""
    entries = (
        spark.read.format("xml").options(rowTag="entry", **XML_OPTIONS).schema(ATOM_ENTRY).load(path)
    )
    return papers_from_entries(entries)


def parse_entry_text(df: DataFrame, column: str) -> DataFrame:
    """Papers of a text column that holds one entry element per row."""
    entry = F.from_xml(F.col(column), ATOM_ENTRY, XML_OPTIONS)
    return papers_from_entries(df.select(entry.alias("entry")), prefix="entry.")


def entries_from_papers(papers: DataFrame) -> DataFrame:
    """Inverse mapping: paper records to entry structs, for writing feed files."""
    link = F.struct(F.lit("pdf").alias("_title"), F.col("pdf_url").alias("_href"))
    return papers.select(
        F.col("arxiv_url").alias("id"),
        "title",
        "summary",
        "published",
        "updated",
        F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("author"),
        F.transform("categories", lambda c: F.struct(c.alias("_term"))).alias("category"),
        F.when(F.col("pdf_url").isNotNull(), F.array(link)).alias("link"),
        "doi",
    )


def write_feeds(papers: DataFrame, path: str) -> None:
    entries_from_papers(papers).write.format("xml").options(rootTag="feed", rowTag="entry").save(path)
