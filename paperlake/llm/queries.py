"""Registered queries of this package: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm import bpe, decontaminate, digest, fim, licenses, merkle, quality, quality_rules, simhash, suffix_dedup, token_counts, toxicity, url_filter
from paperlake.llm.frames import crc_rest


TOKENIZER = "word_bpe_49k.json"
WORD_PIECES = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select(
        "row.doc_id",
        toxicity.held_out("row.doc_id").alias("held_out"),
        "found.score",
        (F.col("found.score") >= toxicity.CUT).cast("int").alias("predicted"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        "found.contaminated",
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select(
        "row.doc_id",
        quality.held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, lang and one of 64 folders. Statements of under 1,000
    characters are licence files, of one of these three directories by their id."""
    found = licenses.statements(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    folder = F.concat(F.lit("d"), F.pmod("row.doc_id", F.lit(64)).cast("string"))
    levels = F.array(F.col("row.source"), F.col("row.lang"), folder)
    short = F.col("license").isNotNull() & (F.length("row.text") < 1000)
    name = F.when(short, F.concat(F.lit("LICENSE."), F.col("row.doc_id"))).otherwise(F.concat(F.col("row.doc_id").cast("string"), F.lit(".txt")))
    depth = F.when(short, F.pmod("row.doc_id", F.lit(3)).cast("int") + 1).otherwise(F.lit(3))
    files = found.select("row.doc_id", F.concat_ws("/", F.array_join(F.slice(levels, F.lit(1), depth), "/"), name).alias("path"), "license", "score")
    return licenses.inherited(files).withColumn("score", F.round("score", 4))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(WORD_PIECES))
    return found.select("row.doc_id", "found.n_words", "found.n_tokens")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of op9: every tenth page's address and those of spam hosts; other spellings of them hit as well."""
    return pages.where((F.col("page_id") % 10 == 0) | url_filter.host_of(F.col("url")).startswith("spam-")).select("url")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, listed_urls(pages)).select("row.page_id", "host", "path", "rule", "verdict")


def op10_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digest.against_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("digest")).alias("fingerprint"),
        F.lower(F.hex("edited_digest")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 2 divides the crc32 of an id, a reader finds the text without its line ends."""
    edited = F.when(crc_rest("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit("")))
    found = merkle.verify_documents(table(spark, sf_dir, "documents"), tampered=edited)
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality_rules.trusted_documents(table(spark, sf_dir, "labels"))
    found = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("row.doc_id", *[f"found.{c}" for c in counts], "found.base_failed", "found.kept", "found.score")


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", *[f"found.{c}" for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_toxicity, op2_decontaminate, op3_simhash, op4_quality, op5_bpe, op6_licenses, op7_suffix_dedup, op8_token_counts, op9_url_filter,
        op10_digest, op11_merkle, op12_quality_rules, op13_fim,
    )
    return {f.__name__: f for f in own}
