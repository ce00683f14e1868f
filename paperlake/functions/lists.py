"""Lists of strings: stored encodings and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.constants import NO_CATEGORY, UNKNOWN
from paperlake.functions.text import strip

# A complete JSON list whose items are all strings. from_json alone also takes
# trailing rubbish and single quotes, which must go down the comma path.
_JSON_STRING = r'"(?:[^"\\\x00-\x1f]++|\\.)*+"'
_JSON_STRING_LIST = rf"\A\[\s*(?:{_JSON_STRING}\s*(?:,\s*{_JSON_STRING}\s*)*+)?\]\z"


def decode(raw: Column) -> Column:
    """Stored text to array: a JSON list of strings, else comma separated."""
    raw = F.coalesce(raw, F.lit(""))
    trimmed = strip(raw)
    parsed = F.when(trimmed.rlike(_JSON_STRING_LIST), F.from_json(trimmed, "array<string>"))
    items = F.coalesce(parsed, F.split(raw, ","))
    return F.filter(F.transform(items, strip), lambda item: item != "")


def encode(items: Column) -> Column:
    """Array to stored JSON text."""
    return F.to_json(items)


def as_list(column: Column, is_array: bool) -> Column:
    """Accept an array or its encoded text; NULL becomes the empty list."""
    if is_array:
        return F.coalesce(column, F.array().cast("array<string>"))
    return decode(column)


def format_authors(authors: Column, limit: int = 3) -> Column:
    shown = F.array_join(F.slice(authors, 1, limit), ", ")
    return (
        F.when(F.size(authors) <= 0, F.lit(UNKNOWN))
        .when(F.size(authors) > limit, F.concat(shown, F.lit(", et al.")))
        .otherwise(shown)
    )


def format_categories(categories: Column, limit: int = 5) -> Column:
    shown = F.array_join(F.slice(categories, 1, limit), ", ")
    return F.when(F.size(categories) <= 0, F.lit(NO_CATEGORY)).otherwise(shown)


def first_or(items: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(default))


def primary_category(categories: Column) -> Column:
    return first_or(categories, NO_CATEGORY)
