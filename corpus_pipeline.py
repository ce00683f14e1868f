"""Cleaning of a training corpus in stages; every stage reads what the one before has written."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm import bpe, decontaminate, simhash, suffix_dedup, toxicity
from paperlake.llm.queries import table, tokenizer_path
from paperlake.runtime import durable


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Whole texts make wide rows. By default up to 64 MB of them go to Python in one batch, and 4,096 are read at
#: once; an executor holds such buffers several times for every task, outside of its heap or as large arrays in it.
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def in_small_batches(stage: Stage) -> Stage:
    """The stage, run in a session that has ``SETTINGS`` from here on (its result is evaluated later)."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the cut stay as they are."""
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("found.score") < toxicity.CUT).select("row.*")


@in_small_batches
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of fingerprints within the operator's radius stays, that of the smallest id."""
    return simhash.keep_first(docs)


def whole_characters(kept: Column, spans: Column) -> Column:
    """Text of the bytes that cuts left over, without the parts of characters at the edges of the cuts.

    Between two cuts the bytes are those of the input, so only a piece's first and last ones can be
    incomplete: leading continuation bytes, and a lead byte with fewer bytes behind it than it asks for.
    """
    gone = lambda upto: F.aggregate(F.slice(spans, F.lit(1), upto), F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    joints = F.transform(spans, lambda s, k: (s["start"] - gone(k)).cast("int"))
    starts = F.concat(F.array(F.lit(0)), joints)
    stops = F.concat(joints, F.array(F.octet_length(kept)))
    piece = lambda at, size: F.substring(kept, at + 1, size)

    def trimmed(start: Column, stop: Column) -> Column:
        head = F.length(F.regexp_extract(F.hex(piece(start, F.least(stop - start, F.lit(3)))), "^(?:[89AB].)*", 0)) / 2
        tail = F.hex(piece(F.greatest(start, stop - 3), F.least(stop - start, F.lit(3))))
        open_end = F.length(F.regexp_extract(tail, "^(?:..)*?([CDEF].|[EF].[89AB].|F.[89AB].[89AB].|)$", 1)) / 2
        size = stop - start - head.cast("int") - open_end.cast("int")
        return piece(start + head.cast("int"), F.greatest(size, F.lit(0))).cast("string")

    joined = F.array_join(F.zip_with(starts, stops, trimmed), "")
    return F.make_valid_utf8(F.when(F.size(spans) > 0, joined).otherwise(kept.cast("string")))


@in_small_batches
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings are cut out; a document that consisted of them alone goes.

    A character that a cut leaves incomplete goes with it; ``n_chars`` follows the text. Null texts
    come out empty.
    """
    found = suffix_dedup.remove_repeats(docs)
    text = whole_characters(F.col("kept"), F.col("spans"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    left = found.where((F.octet_length("kept") > 0) | (F.col("n_bytes") == 0))
    return left.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@in_small_batches
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item stay as they are."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("found.contaminated")).select("row.*")


@in_small_batches
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to."""
    found = bpe.encode_decode(docs, tokenizer_path())
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", decontamination_stage),
    ("bpe encoding", encoding_stage),
]

#: Neighbours' votes, component search, byte-level matches and the encoder have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
