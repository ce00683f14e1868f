"""Replay against a row-by-row fold, in batch, in hot chunks and as a stream."""

import datetime as dt
import random

import pytest

from paperlake.operators import replay
from paperlake.streaming import replay as stream

SCHEMA = (
    "user_id string, guild_id string, paper_id string, ts timestamp, seq long, "
    "command string, status_arg string, note_arg string"
)


def log(n=400, seed=11):
    rng = random.Random(seed)
    kinds = ["save", "remove", "set_status", "set_note"]
    return [
        (
            rng.choice("uv"), "", "hot" if rng.random() < 0.6 else rng.choice(["p1", "p2"]),
            dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 3), i, rng.choice(kinds),
            rng.choice(["to-read", "reading", "done", "bogus", None]), rng.choice([" a note ", "  ", "", "x" * 501]),
        )
        for i in range(n)
    ]


def fold(commands, library=None):
    library, outcomes = dict(library or {}), {}
    for u, g, p, ts, seq, command, status, note in sorted(commands, key=lambda c: (c[3], c[4])):
        key, row = (u, g, p), library.get((u, g, p))
        if command == "save":
            outcomes[seq] = "duplicate" if row else "saved"
            if not row:
                library[key] = ("to-read", None, ts)
        elif command == "set_status" and status not in ("to-read", "reading", "done"):
            outcomes[seq] = "invalid"
        elif command == "set_note" and not 1 <= len(note) <= 500:
            outcomes[seq] = "invalid"
        elif not row:
            outcomes[seq] = "not_found"
        elif command == "remove":
            outcomes[seq] = "removed"
            del library[key]
        else:
            outcomes[seq] = "updated"
            library[key] = (status, row[1], row[2]) if command == "set_status" else (row[0], note.strip(), row[2])
    return outcomes, library


def as_map(df):
    return {(r.user_id, r.guild_id, r.paper_id): (r.status, r.note, r.saved_at) for r in df.collect()}


@pytest.mark.parametrize("hot_rows", [1_000_000, 40])
def test_replay_equals_fold(spark, hot_rows):
    commands = log()
    outcomes, library = fold(commands)
    df = spark.createDataFrame(commands, SCHEMA)
    got = replay.replay_outcomes(df, hot_rows=hot_rows)
    assert {r.seq: r.outcome for r in got.collect()} == outcomes
    assert as_map(replay.replay_library(df, hot_rows=hot_rows)) == library


@pytest.mark.parametrize("hot_rows", [1_000_000, 40])
def test_replay_from_snapshot(spark, hot_rows):
    first, second = log(200, 1), log(200, 2)
    _, before = fold(first)
    outcomes, after = fold(second, before)
    snapshot = spark.createDataFrame(
        [(*k, *v) for k, v in before.items()],
        "user_id string, guild_id string, paper_id string, status string, note string, saved_at timestamp",
    )
    df = spark.createDataFrame(second, SCHEMA)
    assert {r.seq: r.outcome for r in replay.replay_outcomes(df, snapshot, hot_rows).collect()} == outcomes
    assert as_map(replay.replay_library(df, snapshot, hot_rows)) == after


def test_stream_equals_batch(spark, tmp_path):
    commands = log(300)
    landing, path = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        rows = commands[part * 100 : (part + 1) * 100]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{landing}/part{part}")
    source = (
        spark.readStream.schema(spark.createDataFrame([], SCHEMA).schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{landing}/part*")
    )
    stream.start_replay(source, lambda df: df, path).awaitTermination()
    outcomes, library = fold(commands)
    assert as_map(stream.current_library(spark, path)) == library
    assert {r.seq: r.outcome for r in stream.current_outcomes(spark, path).collect()} == outcomes
    assert stream.table(spark, path, "log").before().select("batch").distinct().count() == 3

    # a batch that runs again after a failure changes nothing
    stream.apply_batch(spark.createDataFrame(commands[200:], SCHEMA), path, 2)
    assert as_map(stream.current_library(spark, path)) == library


def test_compacted_stream_goes_on_with_late_and_repeated_batches(spark, tmp_path):
    """Commands arrive in any order, with a compaction on the way: state and outcomes are the fold's."""
    commands, path = log(240), str(tmp_path / "out")
    shuffled = random.Random(4).sample(commands, len(commands))
    batches = [shuffled[k * 60 : (k + 1) * 60] for k in range(4)]
    for k in (0, 1):
        stream.apply_batch(spark.createDataFrame(batches[k], SCHEMA), path, k)
    stream.compact(spark, path, 1)
    stream.compact(spark, path, 1)
    assert stream.table(spark, path, "log").base() == 1
    stream.apply_batch(spark.createDataFrame(batches[1], SCHEMA), path, 1)  # the base has it
    for k in (2, 3, 3):
        stream.apply_batch(spark.createDataFrame(batches[k], SCHEMA), path, k)
    outcomes, library = fold(sorted(commands, key=lambda c: (c[3], c[4])))
    assert as_map(stream.current_library(spark, path)) == library
    assert {r.seq: r.outcome for r in stream.current_outcomes(spark, path).collect()} == outcomes
    stream.compact(spark, path, 3)
    assert as_map(stream.current_library(spark, path)) == library


def test_a_batch_reads_its_buckets_only(spark, tmp_path):
    commands, path = log(120), str(tmp_path / "out")
    stream.apply_batch(spark.createDataFrame(commands, SCHEMA), path, 0)
    table = stream.table(spark, path, "log")
    every = {f for f in table.before(1).inputFiles()}
    some = next(iter(sorted(every))).split("bucket=")[1].split("/")[0]
    read = table.before(1, [int(some)])
    assert 0 < read.count() < len(commands)
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().executedPlan().toString()
