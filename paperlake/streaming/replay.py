"""Command log kept up to date: incremental replay as a streaming job.

The commands themselves are kept, in buckets of the paper key. A micro-batch reads the log of
the keys it touches, from their buckets only, and replays it with its own commands in (ts, seq)
order with the batch operators. So a command that arrives late takes its place in time, and the state
after any arrival order is that of one replay of the whole log. Outcomes of a late command's
successors may change: every batch writes the outcomes of all commands of its keys, the latest count.

All tables are ``buckets.BatchTable``: a batch overwrites its own folders only and reads earlier ones, so it
may run again; ``compact`` folds batches into a base from which the running job goes on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

from paperlake.constants import PAPER_KEY
from paperlake.operators.replay import STATE_COLUMNS, apply_changes, key_changes, replay_outcomes
from paperlake.streaming.buckets import BatchTable

_KEY = [StructField(c, StringType()) for c in PAPER_KEY]
_ORDER = [StructField("ts", TimestampType()), StructField("seq", LongType())]
LOG_SCHEMA = StructType([*_KEY, *_ORDER, *[StructField(c, StringType()) for c in ("command", "status_arg", "note_arg")]])
OUTCOME_SCHEMA = StructType([*_KEY, *_ORDER, StructField("command", StringType()), StructField("outcome", StringType())])
STATE_SCHEMA = StructType(
    [
        *_KEY,
        StructField("status", StringType()),
        StructField("note", StringType()),
        StructField("saved_at", TimestampType()),
        StructField("present", BooleanType()),
    ]
)
SCHEMAS = {"log": LOG_SCHEMA, "outcomes": OUTCOME_SCHEMA, "state": STATE_SCHEMA}


def table(spark: SparkSession, path: str, name: str) -> BatchTable:
    return BatchTable(spark, path, name, SCHEMAS[name], PAPER_KEY)


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row of the latest batch per key."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return last.select(*keys, "_row.*").drop("batch")


def current_library(spark: SparkSession, path: str) -> DataFrame:
    return _latest(table(spark, path, "state").before(), PAPER_KEY).where("present").select(*STATE_COLUMNS)


def current_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcome of every command so far, late ones considered."""
    return _latest(table(spark, path, "outcomes").before(), [*PAPER_KEY, "ts", "seq"])


def apply_batch(commands: DataFrame, path: str, batch_id: int) -> None:
    """Take in one micro-batch. A batch that a base already holds changes nothing."""
    spark = commands.sparkSession
    log = table(spark, path, "log")
    if batch_id <= log.base():
        return
    log.put(commands, batch_id)
    new = spark.read.schema(log.schema).parquet(f"{log.root}/batch={batch_id}")
    buckets = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # BUCKETS at most
    touched = new.select(*PAPER_KEY).distinct()
    columns = [f.name for f in LOG_SCHEMA]
    earlier = log.before(batch_id, buckets).join(touched, PAPER_KEY, "left_semi")
    outcomes = table(spark, path, "outcomes")
    outcomes.put(replay_outcomes(earlier.select(*columns).unionByName(new.select(*columns))), batch_id)
    judged = spark.read.schema(outcomes.schema).parquet(f"{outcomes.root}/batch={batch_id}")
    said = earlier.select(*columns).unionByName(new.select(*columns)).join(
        judged.select(*PAPER_KEY, "ts", "seq", "outcome"), [*PAPER_KEY, "ts", "seq"]
    )
    library = apply_changes(key_changes(said)).withColumn("present", F.lit(True))
    changes = touched.join(library, PAPER_KEY, "left").withColumn("present", F.coalesce("present", F.lit(False)))
    table(spark, path, "state").put(changes, batch_id)


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Fold all batches up to ``upto`` into the base of each table; the job goes on from there.

    Run it between batches. The log keeps every command, so late ones still find their place; state
    and outcomes keep the latest row per key. The log is folded last: a run that breaks off
    before that is simply done again.
    """
    for name, keys in (("state", PAPER_KEY), ("outcomes", [*PAPER_KEY, "ts", "seq"]), ("log", None)):
        own = table(spark, path, name)
        rows = own.before(upto + 1)
        own.fold(_latest(rows, keys) if keys else rows.drop("batch"), upto)


def start_replay(
    source: DataFrame,
    to_commands: Callable[[DataFrame], DataFrame],
    path: str,
    **trigger: object,
) -> StreamingQuery:
    """Start the job; ``trigger`` goes to ``writeStream.trigger`` (default: all available rows)."""
    return (
        to_commands(source)
        .writeStream.foreachBatch(lambda df, batch_id: apply_batch(df, path, batch_id))
        .option("checkpointLocation", f"{path.rstrip('/')}/progress")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
