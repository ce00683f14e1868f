"""Replay in the state store against a row-by-row fold: late commands, restarts, repeats."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperlake.streaming import stateful
from tests.test_replay import SCHEMA, as_map, fold, log

KINDS = ["save", "remove", "set_status", "set_note"]


def told_by_fold(commands):
    state, out = None, {}
    for ts, seq, command, valid, value in sorted(commands, key=lambda c: c[:2]):
        out[ts, seq], state = stateful.step(state, command, valid, value, ts)
    return out, state


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.sampled_from(KINDS), st.booleans(), st.sampled_from("ab")), max_size=60), st.integers(1, 5), st.randoms())
def test_any_arrival_order_is_the_fold(rows, size, rng):
    commands = [(ts, seq, *rest) for seq, (ts, *rest) in enumerate(rows)]
    arriving = rng.sample(commands, len(commands))
    chunks, key_log, seen = {}, stateful.KeyLog({}, None, size), {}
    key_log.chunks = chunks
    while arriving:
        n = rng.randint(1, 9)
        taken, arriving = arriving[:n], arriving[n:]
        again = taken + rng.sample(taken, len(taken))
        for ts, seq, *_, outcome in key_log.take(again):
            assert seen.get((ts, seq)) != outcome
            seen[ts, seq] = outcome
        key_log = stateful.KeyLog(chunks, key_log.head(), size)
    want, state = told_by_fold(commands)
    assert seen == want and key_log.state() == state
    places = [tuple(p[:2]) for p in key_log.places]
    assert places == sorted(places) and all(len(c[0]) <= 2 * size for c in chunks.values())


class Counted(dict):
    reads = 0

    def __getitem__(self, number):
        self.reads += 1
        return super().__getitem__(number)


def test_a_command_costs_the_chunks_it_changes():
    chunks = Counted()
    key_log = stateful.KeyLog(chunks, None, 10)
    key_log.take([(k, k, "save" if k % 50 == 0 else "set_note", True, str(k)) for k in range(1000)])
    assert len(chunks) == 100
    chunks.reads = 0
    assert [e[5] for e in key_log.take([(1000, 1000, "set_note", True, "x")])] == ["updated"]
    assert chunks.reads <= 3  # in order: the last chunk
    chunks.reads = 0
    assert len(key_log.take([(500, 9999, "set_note", True, "late")])) == 1
    assert chunks.reads <= 3  # late, overwritten by the next note of its chunk
    chunks.reads = 0
    changed = key_log.take([(520, 9999, "remove", True, None)])
    assert [e[5] for e in changed] == ["removed", *["not_found"] * 29, "saved"]  # up to the next save, at 550
    assert len(changed) == 31


def landed(spark, landing, parts):
    for name, rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{landing}/{name}")
    schema = spark.createDataFrame([], SCHEMA).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{landing}/part*")


@pytest.mark.parametrize("chunk, slice_rows", [(3, 7), (256, 4096)])
def test_stream_with_late_commands_and_a_restart_is_the_fold(spark, tmp_path, chunk, slice_rows):
    commands, landing, path = log(240, 5), str(tmp_path / "in"), str(tmp_path / "out")
    arriving = random.Random(3).sample(commands, len(commands))
    parts = [(f"part{k}", arriving[k * 80 : (k + 1) * 80]) for k in range(3)]
    held = {name: spark.conf.get(name, None) for name in stateful.SETTINGS}

    source = landed(spark, landing, parts[:2])
    stateful.start_replay(source, lambda df: df, path, chunk, slice_rows).awaitTermination()
    outcomes, library = fold([c for _, rows in parts[:2] for c in rows])
    assert as_map(stateful.current_library(spark, path)) == library
    stateful.compact(spark, path, 1)

    source = landed(spark, landing, [parts[2], ("part3", parts[0][1])])  # the last part comes twice
    stateful.start_replay(source, lambda df: df, path, chunk, slice_rows).awaitTermination()
    outcomes, library = fold(commands)
    assert as_map(stateful.current_library(spark, path)) == library
    told = stateful.current_outcomes(spark, path).collect()
    assert {r.seq: r.outcome for r in told} == outcomes and len(told) == len(commands)
    assert {name: spark.conf.get(name, None) for name in stateful.SETTINGS} == held


def test_null_times_and_empty_input(spark, tmp_path):
    rows = [("u", "", "p", None, 1, "save", None, None), ("u", "", "p", dt.datetime(2024, 1, 1), None, "set_note", None, "n"), ("u", "", "q", dt.datetime(2024, 1, 2), 3, "other", None, None)]
    source = landed(spark, str(tmp_path / "in"), [("part0", rows), ("part1", [])])
    path = str(tmp_path / "out")
    stateful.start_replay(source, lambda df: df, path).awaitTermination()
    assert as_map(stateful.current_library(spark, path)) == {("u", "", "p"): ("to-read", "n", None)}
    assert {(r.seq, r.outcome) for r in stateful.current_outcomes(spark, path).collect()} == {(1, "saved"), (None, "updated"), (3, "not_found")}
