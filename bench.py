"""Headline queries, timed. Prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local threads. The library
tables are written first, as a user has them in store; that time is reported apart.
Every query runs ``BENCH_RUNS`` times into a sink that takes all rows; the best run counts
and the first, with cold code, is reported beside it. ``skewed`` times related papers and pairs with
one tenant that holds a third of all saved papers and asks for its 200 newest ones.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators.library import pages
from paperlake.operators.similarity import cosine_pairs, related_papers
from paperlake.plans.inputs import Inputs
from paperlake.plans.queries import queries

HEADLINE = [
    "related_papers",
    "related_external",
    "pairwise_similarity",
    "corpus_search_sorted",
    "term_frequencies",
    "library_listing",
    "library_one_tenant",
    "library_pages",
    "library_stats",
    "library_cards",
    "collection_counts",
    "collection_papers",
    "export_collection",
    "cite_bibtex",
    "save_papers",
    "add_to_collection",
    "set_status",
    "remove_papers_applied",
    "replay_library",
    "replay_stream",
    "atom_ingest",
    "orphan_memberships",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("paperlake-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="paperlake-bench-"))
    return spark


def skewed_cases(i: Inputs) -> dict[str, Callable[[], DataFrame]]:
    """One tenant with a third of all rows; requests for its newest papers and pairs of neighbours."""
    third = F.pmod(F.xxhash64("user_id", "guild_id", "paper_id"), F.lit(3)) == 0
    saved = i.saved.select("user_id", "guild_id", "paper_id", "saved_at")
    for column in ("user_id", "guild_id"):
        saved = saved.withColumn(column, F.when(third, F.lit("hot")).otherwise(F.col(column)))
    saved = saved.groupBy("user_id", "guild_id", "paper_id").agg(F.max("saved_at").alias("saved_at"))
    hot = saved.where("user_id = 'hot'")
    newest = hot.orderBy(F.desc("saved_at"), "paper_id").limit(200)
    ends = saved.groupBy("user_id", "guild_id").agg(F.min("paper_id").alias("paper_a"), F.max("paper_id").alias("paper_b"))
    return {
        "related_papers": lambda: related_papers(newest, saved, i.bags),
        "pairwise_similarity": lambda: cosine_pairs(ends, saved, i.bags),
        "library_pages": lambda: pages(saved),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    started = time.perf_counter()
    Inputs(spark, folder).prepare()
    prepared = time.perf_counter() - started

    catalogue = queries()
    best: dict[str, float] = {}
    first: dict[str, float] = {}
    for name in HEADLINE:
        for run in range(runs):
            started = time.perf_counter()
            catalogue[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = round(time.perf_counter() - started, 3)
            first.setdefault(name, took)
            best[name] = min(best.get(name, took), took)
    skewed: dict[str, float] = {}
    for name, build in skewed_cases(Inputs(spark, folder)).items():
        started = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        skewed[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "first_run": first,
                "prepare_sec": round(prepared, 3),
                "total_with_prepare": round(prepared + sum(best.values()), 3),
                "skewed": skewed,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
