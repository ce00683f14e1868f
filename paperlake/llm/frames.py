"""Small helpers that several operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keeps A-Z folded to a-z, maps every other byte to itself.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bytes of ``[0-9a-z\x80-\U0010ffff]`` after lowering; all others become a space.
ALNUM = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in LOWER)


def release() -> None:
    """Hand memory that is free again back to the system: a Python worker lives on from task to task, with what it once took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def freed(function: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A function of one group or of a pair of groups that hands memory back once its variables are gone, after a task's last group too."""

    def one(table: pa.Table) -> pa.Table:
        out = function(table)
        release()
        return out

    def two(table: pa.Table, other: pa.Table) -> pa.Table:
        out = function(table, other)
        release()
        return out

    return one if len(inspect.signature(function).parameters) == 1 else two


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every value of a string column; null is empty."""
    return [b"" if value is None else value for value in column.cast(pa.binary()).to_pylist()]


def partitions_for(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def per_batch(function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """A ``mapInArrow`` function from one that maps a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)
        release()

    return run


def crc_rest(column: str, by: int):
    """``crc32(column as text) mod by``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[k] .. starts[k] + lengths[k] - 1`` of all k, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    steps = np.arange(total, dtype=np.int64)
    return steps + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def chunks(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    """The texts in order, in lists of about ``size`` bytes."""
    held, total = [], 0
    for text in texts:
        held.append(text)
        total += len(text)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def map_texts(
    docs: DataFrame, fields: str, function: Callable[..., list[pa.Array]], text: str = "text", chunk_bytes: int = 8 << 20, beside: str | None = None
) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and ``found`` (a struct of ``fields``) of every row.

    ``function`` gets the UTF-8 texts of some rows and returns one array per field. It sees about
    ``chunk_bytes`` of text at once where a partition has as many, and with ``beside`` that column's
    values as a second list. Own names of ``docs`` never clash
    with the fields, as either side stays in its struct.
    """
    schema = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index(text)
    at_beside = None if beside is None else docs.columns.index(beside)
    names = [part.split()[0] for part in fields.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []  # rows whose texts are not looked at yet
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            given = [[t for row in held for t in texts_of(row.field(at))]]
            if at_beside is not None:
                given.append([v for row in held for v in row.field(at_beside).to_pylist()])
            made = [pa.array(a) for a in function(*given)]
            start = 0
            for row in held:
                part = pa.StructArray.from_arrays([a.slice(start, len(row)) for a in made], names)
                yield pa.RecordBatch.from_arrays([row, part], ["row", "found"])
                start += len(row)

        for batch in batches:
            row, start = batch.column(0), 0
            lengths = pc.binary_length(row.field(at)).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths.astype(np.int64))
            while start < len(row):
                before = int(ends[start - 1]) if start else 0
                stop = min(len(row), int(np.searchsorted(ends, before + max(chunk_bytes - size, 1))) + 1)
                held.append(pa.StructArray.from_arrays([f.slice(start, stop - start) for f in row.flatten()], fields=list(row.type)))
                size += int(ends[stop - 1]) - before
                start = stop
                if size >= chunk_bytes:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
            held.clear()
        release()

    row_type = schema.schema["row"].dataType.simpleString()
    return schema.mapInArrow(run, f"row {row_type}, found struct<{fields.replace(' ', ':').replace(',:', ',')}>")
