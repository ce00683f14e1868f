"""Citation rendering and delivery routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlake.constants import CITATION_FORMATS, FENCE_TAGS, FILE_EXTENSIONS, INLINE_LIMIT, UNKNOWN
from paperlake.functions.lists import primary_category
from paperlake.functions.text import strip


def _blank(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) == ""


def last_first(name: Column) -> Column:
    """'First Last' to 'Last, First'; a single word stays as it is."""
    return F.regexp_replace(strip(name), r"(?s)\A(.*) ([^ ]*)\z", "$2, $1")


def bibtex_key(authors: Column, published: Column) -> Column:
    first = strip(F.coalesce(F.try_element_at(authors, F.lit(1)), F.lit("unknown")))
    surname = F.lower(F.regexp_replace(F.substring_index(first, " ", -1), "[^a-zA-Z0-9]", ""))
    year = F.when(_blank(published), F.lit("nd")).otherwise(F.substring(published, 1, 4))
    return F.concat(F.when(surname == "", F.lit("unknown")).otherwise(surname), year)


def escape_bibtex(text: Column) -> Column:
    """Escape LaTeX specials; splitting at backslashes keeps the two steps apart."""
    parts = F.transform(
        F.split(text, r"\\", -1), lambda p: F.regexp_replace(p, r"([&%#_{}])", r"\\$1")
    )
    return F.array_join(parts, "\\textbackslash{}")


def cite_bibtex(p: dict[str, Column]) -> Column:
    """BibTeX entry. The label column layout below is a fixed format."""
    names = F.array_join(F.transform(p["authors"], last_first), " and ")
    fields = [
        ("  title     = {", escape_bibtex(p["title"])),
        ("  author    = {", F.when(names == "", F.lit(UNKNOWN)).otherwise(names)),
        ("  year      = {", F.substring(F.coalesce(p["published"], F.lit("")), 1, 4)),
        ("  eprint    = {", p["paper_id"]),
        ("  archivePrefix = {", F.lit("arXiv")),
        ("  primaryClass  = {", primary_category(p["categories"])),
        ("  url       = {", p["arxiv_url"]),
    ]
    lines = [F.concat(F.lit(label), value, F.lit("},")) for label, value in fields]
    doi = F.when(~_blank(p["doi"]), F.concat(F.lit("  doi       = {"), p["doi"], F.lit("},")))
    head = F.concat(F.lit("@article{"), bibtex_key(p["authors"], p["published"]), F.lit(","))
    # concat_ws leaves NULL lines out, which drops the doi line where there is none
    return F.concat_ws("\n", head, *lines, doi, F.lit("}"))


def _names_and_year(p: dict[str, Column]) -> Column:
    names = F.when(F.size(p["authors"]) <= 0, F.lit(UNKNOWN)).otherwise(F.array_join(p["authors"], ", "))
    year = F.when(_blank(p["published"]), F.lit("")).otherwise(
        F.concat(F.lit(" ("), F.substring(p["published"], 1, 4), F.lit(")"))
    )
    return F.concat(names, year)


def _doi_tail(p: dict[str, Column]) -> Column:
    return F.when(_blank(p["doi"]), F.lit("")).otherwise(F.concat(F.lit(" doi:"), p["doi"]))


def cite_plain(p: dict[str, Column]) -> Column:
    return F.concat(
        _names_and_year(p), F.lit(". "), p["title"], F.lit(". arXiv:"), p["paper_id"], F.lit("."), _doi_tail(p)
    )


def cite_markdown(p: dict[str, Column]) -> Column:
    return F.concat(
        _names_and_year(p), F.lit(". **"), p["title"], F.lit("**. [arXiv:"), p["paper_id"],
        F.lit("]("), p["arxiv_url"], F.lit(")"), _doi_tail(p),
    )


_RENDERERS = {"bibtex": cite_bibtex, "plain": cite_plain, "markdown": cite_markdown}
_INPUTS = ("paper_id", "title", "authors", "published", "categories", "arxiv_url", "doi")


def cite(fmt: str) -> Column:
    """Citation of the row's paper columns in one of the three formats."""
    if fmt not in CITATION_FORMATS:
        raise ValueError(f"unknown citation format {fmt!r}")
    return _RENDERERS[fmt]({name: F.col(name) for name in _INPUTS})


def per_format(fmt: Column, values: dict[str, str]) -> Column:
    """Value chosen by a format column."""
    return reduce(lambda acc, kv: acc.when(fmt == kv[0], F.lit(kv[1])), values.items(), F)


def fence_tag(fmt: Column) -> Column:
    return per_format(fmt, FENCE_TAGS)


def file_extension(fmt: Column) -> Column:
    return per_format(fmt, FILE_EXTENSIONS)


def citation_heading(fmt: Column, paper_id: Column) -> Column:
    return F.concat(F.lit("**"), F.initcap(fmt), F.lit(" citation for** `"), paper_id, F.lit("`"))


def fenced(text: Column, fmt: Column, heading: Column | None = None) -> Column:
    block = F.concat(F.lit("```"), fence_tag(fmt), F.lit("\n"), text, F.lit("\n```"))
    return block if heading is None else F.concat(heading, F.lit("\n"), block)


def delivery(payload_length: Column) -> Column:
    return F.when(payload_length < INLINE_LIMIT, F.lit("inline")).otherwise(F.lit("file"))
