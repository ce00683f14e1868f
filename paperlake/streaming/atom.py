"""Feed landing folder kept in a corpus table, one row per paper id, first one wins.

Like the replay job, a batch overwrites its own folder only and looks at earlier batches alone, in
the buckets of the ids it brings, so running it again changes nothing. The corpus remembers every
id; a watermark would forget ids past its delay. ``compact`` folds batches into a base.

``repeats_within`` puts a filter before that look-up: an entry that came with the very same content
within the delay goes no further. It is only a saving. A repeat past the delay, or another version
of a paper, takes the exact look-up, so the corpus is the same with and without it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperlake.operators.mutations import first_rows
from paperlake.sources.atom import XML_OPTIONS, papers_from_entries
from paperlake.sources.schemas import ATOM_ENTRY, PAPER
from paperlake.streaming.buckets import BatchTable, bucket_of

def corpus(spark: SparkSession, path: str) -> BatchTable:
    return BatchTable(spark, path, "corpus", PAPER, ["paper_id"])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return corpus(spark, path).before().drop("batch")


def add_batch(entries: DataFrame, path: str, batch_id: int) -> None:
    """Append the papers of one micro-batch whose id is new."""
    own = corpus(entries.sparkSession, path)
    if batch_id <= own.base():
        return
    papers = papers_from_entries(entries)
    # entries of one batch have no order of their own; the earliest version comes first
    order = ["updated", "published", "arxiv_url", "title", "summary"]
    new = first_rows(papers, ["paper_id"], order).persist()  # two actions follow; the feed is read and the state asked once
    try:
        buckets = sorted(r["b"] for r in new.select(bucket_of(["paper_id"]).alias("b")).distinct().collect())  # BUCKETS at most
        known = own.before(batch_id, buckets).select("paper_id")
        own.put(new.join(known, "paper_id", "left_anti"), batch_id)
    finally:
        new.unpersist()


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Fold all batches up to ``upto`` into one base; run it between batches."""
    own = corpus(spark, path)
    own.fold(own.before(upto + 1).drop("batch"), upto)


def without_repeats(entries: DataFrame, delay: str) -> DataFrame:
    """A stream of entries without those whose whole content came before within ``delay``.

    The clock is the arrival of the batch, not ``updated``: feeds bring old papers late, and rows
    behind a watermark on ``updated`` would be lost. Versions differ in content and all stay, so
    that the earliest one of a batch is still chosen. The state holds a digest per entry for the delay;
    equal entries of one batch meet in one task, which ``max_files`` bounds.
    """
    fields = entries.columns
    return (
        entries.withColumns({"_digest": F.sha2(F.to_json(F.struct(*fields)), 256), "_arrived": F.current_timestamp()})
        .withWatermark("_arrived", delay)
        .dropDuplicatesWithinWatermark(["_digest"])
        .select(*fields)
    )


def start_ingest(
    spark: SparkSession,
    landing: str,
    path: str,
    max_files: int | None = None,
    repeats_within: str | None = None,
    **trigger: object,
) -> StreamingQuery:
    """Ingest the feeds of ``landing``; ``repeats_within`` (such as "2 days") stays as it was at a table's first run."""
    reader = spark.readStream.format("xml").options(rowTag="entry", **XML_OPTIONS).schema(ATOM_ENTRY)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    entries = reader.load(landing)
    if repeats_within is not None:
        entries = without_repeats(entries, repeats_within)
    return (
        entries.writeStream.foreachBatch(lambda df, batch_id: add_batch(df, path, batch_id))
        .option("checkpointLocation", f"{path.rstrip('/')}/progress")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
