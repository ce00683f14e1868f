"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _text(name: str, nullable: bool = True) -> StructField:
    return StructField(name, StringType(), nullable)


PAPER = StructType(
    [
        _text("paper_id", False),
        _text("title", False),
        StructField("authors", ArrayType(StringType()), False),
        _text("summary"),
        _text("published"),
        _text("updated"),
        StructField("categories", ArrayType(StringType()), False),
        _text("arxiv_url", False),
        _text("pdf_url"),
        _text("doi"),
    ]
)

SAVED_PAPERS = StructType(
    [
        StructField("id", LongType(), False),
        _text("user_id", False),
        _text("guild_id", False),
        _text("paper_id", False),
        _text("title", False),
        _text("authors", False),
        _text("summary"),
        _text("published"),
        _text("categories"),
        _text("arxiv_url", False),
        _text("pdf_url"),
        _text("doi"),
        _text("status", False),
        _text("note"),
        StructField("saved_at", TimestampType(), False),
    ]
)

COLLECTIONS = StructType(
    [
        StructField("id", LongType(), False),
        _text("user_id", False),
        _text("guild_id", False),
        _text("name", False),
        StructField("created_at", TimestampType(), False),
    ]
)

COLLECTION_PAPERS = StructType(
    [
        StructField("collection_id", LongType(), False),
        _text("paper_id", False),
        _text("user_id", False),
        _text("guild_id", False),
        StructField("added_at", TimestampType(), False),
    ]
)

TABLES = {
    "saved_papers": SAVED_PAPERS,
    "collections": COLLECTIONS,
    "collection_papers": COLLECTION_PAPERS,
}

# One Atom entry as the XML reader sees it, name spaces ignored.
ATOM_ENTRY = StructType(
    [
        _text("id"),
        _text("title"),
        _text("summary"),
        _text("published"),
        _text("updated"),
        StructField("author", ArrayType(StructType([_text("name")]))),
        StructField("category", ArrayType(StructType([_text("_term")]))),
        StructField("link", ArrayType(StructType([_text("_title"), _text("_href")]))),
        _text("doi"),
    ]
)
