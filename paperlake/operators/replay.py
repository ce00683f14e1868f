"""Ordered replay of a command log over all libraries.

``commands``: user_id, guild_id, paper_id, ts, seq, command (save, remove, set_status,
set_note), status_arg, note_arg. Each outcome depends on the state just before it, which
is the last save or remove of the same paper: a running ``last`` inside the key. Keys
with very many commands are cut into ordered chunks and the state is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.constants import DEFAULT_STATUS, NOTE_MAX_LENGTH, NOTE_MIN_LENGTH, PAPER_KEY, STATUSES
from paperlake.functions.text import strip
from paperlake.operators.skew import HOT_ROWS, ordered_chunks

STATE_COLUMNS = [*PAPER_KEY, "status", "note", "saved_at"]


def bad_arguments() -> Column:
    """A status that does not exist, or a note of a length that is not allowed."""
    status = ~F.coalesce(F.col("status_arg").isin(*STATUSES), F.lit(False))
    note = ~F.coalesce(F.length("note_arg").between(NOTE_MIN_LENGTH, NOTE_MAX_LENGTH), F.lit(False))
    return F.coalesce(F.when(F.col("command") == "set_status", status).when(F.col("command") == "set_note", note), F.lit(False))


def replay_outcomes(
    commands: DataFrame, snapshot: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Commands with ``outcome``: saved, duplicate, updated, removed, not_found or invalid."""
    order = [F.col("ts"), F.col("seq")]
    chunked, split = ordered_chunks(commands, PAPER_KEY, order, hot_rows)
    mark = F.when(F.col("command") == "save", 1).when(F.col("command") == "remove", 0)
    chunked = chunked.withColumn("mark", mark)
    parts = [*PAPER_KEY, "chunk"]
    before = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    state = F.last("mark", ignorenulls=True).over(before)
    rows = chunked.withColumn("_before", state)
    carried = [F.col("_before")]
    held = None if snapshot is None else snapshot.select(*PAPER_KEY, F.lit(1).alias("_held"))
    if split:
        # last mark of each chunk, carried forward: one row per chunk
        ends = chunked.groupBy(*parts).agg(
            F.max_by("mark", F.when(F.col("mark").isNotNull(), F.struct("ts", "seq"))).alias("_end")
        )
        earlier = Window.partitionBy(*PAPER_KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        start = F.last("_end", ignorenulls=True).over(earlier)
        if held is not None:
            ends = ends.join(held, PAPER_KEY, "left")
            start = F.coalesce(start, F.col("_held"))
        rows = rows.join(ends.select(*parts, start.alias("_start")), parts)
        carried.append(F.col("_start"))
    elif held is not None:
        rows = rows.join(held, PAPER_KEY, "left")
        carried.append(F.col("_held"))
    present = F.coalesce(*carried, F.lit(0)) == 1
    outcome = (
        F.when((F.col("command") == "save") & present, "duplicate")
        .when(F.col("command") == "save", "saved")
        .when(bad_arguments(), "invalid")
        .when(~present, "not_found")
        .when(F.col("command") == "remove", "removed")
        .otherwise("updated")
    )
    return rows.select(*commands.columns, outcome.alias("outcome"))


def key_changes(outcomes: DataFrame) -> DataFrame:
    """What the log did to each paper key; aggregates before the shuffle."""
    at = [F.col("ts"), F.col("seq")]
    updated = F.col("outcome") == "updated"
    return outcomes.groupBy(*PAPER_KEY).agg(
        F.max_by(
            F.when(F.col("command") == "save", 1).otherwise(0),
            F.when(F.col("command").isin("save", "remove"), F.struct(*at)),
        ).alias("last_mark"),
        F.max(F.when(F.col("outcome") == "saved", F.struct(*at))).alias("epoch"),
        F.max(
            F.when(updated & (F.col("command") == "set_status"), F.struct(*at, F.col("status_arg").alias("value")))
        ).alias("status_change"),
        F.max(
            F.when(
                updated & (F.col("command") == "set_note"),
                F.struct(*at, strip(F.col("note_arg")).alias("value")),
            )
        ).alias("note_change"),
    )


def _after_epoch(change: str, before: str) -> Column:
    """Value of a change, if it came after the last effective save."""
    c = F.col(change)
    moved = F.col("epoch").isNull() | (F.struct(c["ts"], c["seq"]) > F.col("epoch"))
    kept = F.when(F.col("epoch").isNull(), F.col(before))
    return F.when(c.isNotNull() & moved, c["value"]).otherwise(kept)


def apply_changes(changes: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Library after the changes: a paper saved anew starts from the default state."""
    if snapshot is None:
        base = changes.withColumns(
            {
                "_status": F.lit(None).cast("string"),
                "_note": F.lit(None).cast("string"),
                "_saved_at": F.lit(None).cast("timestamp"),
            }
        )
    else:
        held = snapshot.select(
            *PAPER_KEY,
            F.col("status").alias("_status"),
            F.col("note").alias("_note"),
            F.col("saved_at").cast("timestamp").alias("_saved_at"),
        )
        base = held.join(changes, PAPER_KEY, "full")
    present = F.when(F.col("last_mark").isNotNull(), F.col("last_mark") == 1).otherwise(
        F.col("_saved_at").isNotNull()
    )
    return base.where(present).select(
        *PAPER_KEY,
        F.coalesce(_after_epoch("status_change", "_status"), F.lit(DEFAULT_STATUS)).alias("status"),
        _after_epoch("note_change", "_note").alias("note"),
        F.coalesce(F.col("epoch.ts").cast("timestamp"), F.col("_saved_at")).alias("saved_at"),
    )


def replay_library(
    commands: DataFrame, snapshot: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Final library: user_id, guild_id, paper_id, status, note, saved_at."""
    return apply_changes(key_changes(replay_outcomes(commands, snapshot, hot_rows)), snapshot)
