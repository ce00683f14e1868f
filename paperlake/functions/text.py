"""Text rules as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.constants import (
    MIN_TOKEN_LENGTH,
    NO_ABSTRACT,
    QUICK_SUMMARY_LIMIT,
    STOPWORDS,
    TOKEN_PATTERN,
    UNKNOWN,
)

# (?U) makes \s mean Unicode white space; the four separators are white space in
# Python's text model but not in Unicode's property.
_SPACE = r"[\s\x1c-\x1f]"
_LEADING = rf"(?U)\A{_SPACE}++"
# The look-behind lets only the start of a run match, so inner runs stay linear.
_TRAILING = rf"(?U)(?<!{_SPACE}){_SPACE}++\z"


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, _TRAILING, "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"{_LEADING}|{_TRAILING}", "")


def clean_text(text: Column) -> Column:
    """Collapse white-space runs to one blank and strip; NULL becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U){_SPACE}++", " "))


def truncate(text: Column, limit: int) -> Column:
    """Cut to ``limit`` code points, the last three being an ellipsis."""
    if limit < 4:
        raise ValueError("limit must leave room for one character and the ellipsis")
    text = F.coalesce(text, F.lit(""))
    cut = F.concat(rstrip(F.substring(text, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def date_part(iso: Column) -> Column:
    """First ten characters of an ISO instant, or the unknown marker."""
    return F.when(F.coalesce(iso, F.lit("")) == "", F.lit(UNKNOWN)).otherwise(F.substring(iso, 1, 10))


def quick_summary(abstract: Column) -> Column:
    """First two sentences, where a sentence ends at any full stop."""
    abstract = F.coalesce(abstract, F.lit(""))
    pieces = F.transform(F.split(F.replace(abstract, F.lit("\n"), F.lit(" ")), r"\."), strip)
    sentences = F.filter(pieces, lambda s: s != "")
    joined = F.concat(F.array_join(F.slice(sentences, 1, 2), ". "), F.lit("."))
    return (
        F.when(abstract == "", F.lit(NO_ABSTRACT))
        .when(F.size(sentences) == 0, F.substring(abstract, 1, QUICK_SUMMARY_LIMIT))
        .otherwise(F.substring(joined, 1, QUICK_SUMMARY_LIMIT))
    )


def tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumeric runs without stopwords and one-letter runs."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(
        runs, lambda t: (F.length(t) >= MIN_TOKEN_LENGTH) & ~t.isin(STOPWORDS)
    )


def paper_text(title: Column, summary: Column, categories: Column) -> Column:
    """Text that represents a paper in similarity; the title counts twice."""
    return F.concat_ws(" ", title, title, summary, F.array_join(categories, " "))
