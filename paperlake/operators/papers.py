"""Paper records on their own: details and single citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.functions.citations import (
    cite,
    citation_heading,
    delivery,
    fenced,
    file_extension,
)
from paperlake.functions.display import detail_fields
from paperlake.operators.library import normalise_papers


def details(papers: DataFrame) -> DataFrame:
    """Fields of the detail view."""
    return normalise_papers(papers).select(
        "paper_id", *[value.alias(name) for name, value in detail_fields().items()]
    )


def citation_payloads(papers: DataFrame, fmt: str, with_heading: bool = True) -> DataFrame:
    """Citation, delivery and message per paper; long ones go to a file."""
    cited = normalise_papers(papers).select("paper_id", F.lit(fmt).alias("format"), cite(fmt).alias("citation"))
    return citation_delivery(cited, with_heading)


def citation_delivery(cited: DataFrame, with_heading: bool = True) -> DataFrame:
    """Routing for rows of paper_id, format, citation."""
    fmt = F.col("format")
    heading = citation_heading(fmt, F.col("paper_id")) if with_heading else None
    message = fenced(F.col("citation"), fmt, heading)
    return (
        cited.withColumn("_message", message)
        .withColumn("delivery", delivery(F.length("_message")))
        .withColumn("payload", F.when(F.col("delivery") == "inline", F.col("_message")))
        .withColumn("file_name", F.concat(F.col("paper_id"), F.lit("."), file_extension(fmt)))
        .drop("_message")
    )
