"""Command replay as a stateful operator: the log of each paper key lives in the state store.

A key's commands are kept in (ts, seq) order in chunks, one map entry each, with the paper's state
behind the chunk. Commands that come in order are judged from the last chunk's state. A late command
goes into the chunk of its time; chunks behind it are judged again only until one ends in the state that
it had before. So a batch reads and writes what it changes, whatever the length of the log. Given out
are outcomes that are new or have changed, and the state of each key touched; both with a version that grows
within the key, of which the largest counts. A command is known by (ts, seq): one that comes again is left out.

A key is one group and so one task per batch: its commands pass in slices, its chunks lie on disk, but
they are not spread. For keys that hold a large part of all commands take ``streaming.replay``, whose
batches split them. The list of a key's chunks (three numbers for each) is read and written as a whole.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, MutableMapping
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from paperlake.constants import DEFAULT_STATUS, PAPER_KEY
from paperlake.functions.text import strip
from paperlake.operators.replay import STATE_COLUMNS, bad_arguments
from paperlake.streaming.buckets import BatchTable

CHUNK = 256
SLICE = 4096
#: Stands for a null time or number, which sort first.
FIRST = -(2**63)
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
CHANGES = StructType(
    [
        *[StructField(c, StringType()) for c in PAPER_KEY],
        StructField("version", LongType()),
        StructField("ts", LongType()),
        StructField("seq", LongType()),
        StructField("command", StringType()),
        StructField("outcome", StringType()),
        StructField("present", BooleanType()),
        StructField("status", StringType()),
        StructField("note", StringType()),
        StructField("saved_at", LongType()),
    ]
)
_CHANGE = Row(*CHANGES.names)


def step(state: list | None, command: str, valid: bool, value: str | None, ts: int) -> tuple[str, list | None]:
    """Outcome of a command and the state (status, note, saved_at; None: not saved) behind it."""
    if command == "save":
        return ("saved", [DEFAULT_STATUS, None, ts]) if state is None else ("duplicate", state)
    if not valid:
        return "invalid", state
    if state is None:
        return "not_found", None
    if command == "remove":
        return "removed", None
    status, note, saved_at = state
    if command == "set_status":
        status = value
    elif command == "set_note":
        note = value
    return "updated", [status, note, saved_at]


class KeyLog:
    """Commands of one key in chunks of a store (id to (commands, state behind them)).

    ``places`` lists the chunks in order as [ts, seq, id], by their first command; what is earlier than all
    goes to the first chunk.
    """

    def __init__(self, chunks: MutableMapping[int, tuple[list, list | None]], head: dict | None, size: int = CHUNK) -> None:
        self.chunks, self.size = chunks, size
        self.places, self.next_id, self.version = (head["places"], head["next"], head["version"]) if head else ([], 0, 0)

    def head(self) -> dict:
        return {"places": self.places, "next": self.next_id, "version": self.version}

    def state(self) -> list | None:
        return self.chunks[self.places[-1][2]][1] if self.places else None

    def take(self, commands: Iterable[tuple]) -> list[list]:
        """Take in (ts, seq, command, valid, value); entries whose outcome is new or has changed."""
        self.version += 1
        starts = [(ts, seq) for ts, seq, _ in self.places]
        open_: dict[int, list] = {}
        for c in sorted(commands, key=lambda c: (c[0], c[1])):
            open_.setdefault(max(bisect_right(starts, (c[0], c[1])) - 1, 0), []).append(c)
        changed: list[list] = []
        old, places, k = self.places, [], 0
        state, settled = None, True
        while open_ or (not settled and k < len(old)):
            if settled and (at := min(open_)) > k:  # on to the next chunk with new commands
                places += old[k:at]
                k, state = at, self.chunks[old[at - 1][2]][1]
            entries, before = self.chunks[old[k][2]] if k < len(old) else ([], None)
            told = {(e[0], e[1]) for e in entries}
            for ts, seq, command, valid, value in open_.pop(k, ()):
                if (ts, seq) not in told:
                    told.add((ts, seq))
                    entries.append([ts, seq, command, valid, value, None])
            entries.sort(key=lambda e: (e[0], e[1]))
            cut = self.size if len(entries) > 2 * self.size else max(len(entries), 1)
            for start in range(0, len(entries), cut):
                piece = entries[start : start + cut]
                for e in piece:
                    outcome, state = step(state, e[2], e[3], e[4], e[0])
                    if outcome != e[5]:
                        e[5] = outcome
                        changed.append(e)
                if start == 0 and k < len(old):
                    number = old[k][2]
                else:
                    number, self.next_id = self.next_id, self.next_id + 1
                place = [*piece[0][:2], number]
                self.chunks[place[2]] = (piece, state)
                places.append(place)
            settled, k = k >= len(old) or state == before, k + 1
        self.places = places + old[k:]
        return changed


class _StoredChunks(MutableMapping):
    """Chunks of a key in its map state; the last one read or written is at hand."""

    def __init__(self, stored) -> None:
        self.stored, self.last = stored, None

    def __getitem__(self, number: int) -> tuple[list, list | None]:
        if self.last is None or self.last[0] != number:
            commands, after = self.stored.getValue((number,))
            self.last = number, commands, after
        return json.loads(self.last[1]), json.loads(self.last[2])

    def __setitem__(self, number: int, chunk: tuple[list, list | None]) -> None:
        self.last = number, json.dumps(chunk[0]), json.dumps(chunk[1])
        self.stored.updateValue((number,), self.last[1:])

    def __delitem__(self, number: int) -> None:
        self.stored.removeKey((number,))

    def __iter__(self) -> Iterator[int]:
        return (k[0] for k in self.stored.keys())

    def __len__(self) -> int:
        return sum(1 for _ in self)


class PaperReplay(StatefulProcessor):
    def __init__(self, chunk: int = CHUNK, slice_rows: int = SLICE) -> None:
        self.size, self.slice_rows = chunk, slice_rows

    def init(self, handle) -> None:
        self.index = handle.getValueState("index", "head string")
        self.chunks = handle.getMapState("chunks", "id long", "commands string, after string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        head = json.loads(self.index.get()[0]) if self.index.exists() else None
        log = KeyLog(_StoredChunks(self.chunks), head, self.size)
        while taken := [(r["ts"], r["seq"], r["command"], r["valid"], r["value"]) for r in islice(rows, self.slice_rows)]:
            for ts, seq, command, _, _, outcome in log.take(taken):
                yield _CHANGE(*key, log.version, ts, seq, command, outcome, None, None, None, None)
        self.index.update((json.dumps(log.head()),))
        state = log.state()
        yield _CHANGE(*key, log.version, None, None, None, None, state is not None, *(state or (None, None, None)))


def _ordinal(column: Column) -> Column:
    return F.coalesce(column, F.lit(FIRST))


def judged(commands: DataFrame, chunk: int = CHUNK, slice_rows: int = SLICE) -> DataFrame:
    """Changes (see ``CHANGES``; rows without ``outcome`` are states) of a streaming log of commands."""
    value = F.when(F.col("command") == "set_status", F.col("status_arg")).when(F.col("command") == "set_note", strip(F.col("note_arg")))
    rows = commands.select(
        *PAPER_KEY,
        _ordinal(F.unix_micros(F.col("ts").cast("timestamp"))).alias("ts"),
        _ordinal(F.col("seq")).alias("seq"),
        "command",
        (~bad_arguments()).alias("valid"),
        value.alias("value"),
    )
    return rows.groupBy(*PAPER_KEY).transformWithState(PaperReplay(chunk, slice_rows), CHANGES, "Update", "None")


def table(spark: SparkSession, path: str) -> BatchTable:
    return BatchTable(spark, path, "changes", CHANGES, PAPER_KEY)


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_row")).select(*keys, "_row.*")


def _instant(name: str) -> Column:
    return F.when(F.col(name) != FIRST, F.timestamp_micros(name)).alias(name)


def current_library(spark: SparkSession, path: str) -> DataFrame:
    states = _latest(table(spark, path).before().where("outcome is null"), PAPER_KEY)
    return states.where("present").select(*[_instant(c) if c == "saved_at" else F.col(c) for c in STATE_COLUMNS])


def current_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcome of every command so far, late ones considered."""
    told = _latest(table(spark, path).before().where("outcome is not null"), [*PAPER_KEY, "ts", "seq"])
    return told.select(*PAPER_KEY, _instant("ts"), F.nullif("seq", F.lit(FIRST)).alias("seq"), "command", "outcome")


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Fold the changes up to batch ``upto`` into a base with one row per command and per key."""
    own = table(spark, path)
    rows = own.before(upto + 1).drop("batch")
    own.fold(_latest(rows.where("outcome is null"), PAPER_KEY).unionByName(_latest(rows.where("outcome is not null"), [*PAPER_KEY, "ts", "seq"])), upto)


def start_replay(
    source: DataFrame,
    to_commands: Callable[[DataFrame], DataFrame],
    path: str,
    chunk: int = CHUNK,
    slice_rows: int = SLICE,
    **trigger: object,
) -> StreamingQuery:
    """Start the job, or go on with it from the state that ``path`` holds.

    ``trigger`` goes to ``writeStream.trigger`` (default: all available rows). The state store's settings
    are the session's own again once the job has started.
    """
    spark = source.sparkSession
    own = table(spark, path)

    def put(changes: DataFrame, batch_id: int) -> None:
        if batch_id > own.base():
            own.put(changes, batch_id)

    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        return (
            judged(to_commands(source), chunk, slice_rows)
            .writeStream.outputMode("update")
            .foreachBatch(put)
            .option("checkpointLocation", f"{path.rstrip('/')}/progress")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
