"""Similarity digests from improbable features.

A feature is a window of ``WINDOW`` bytes. Its entropy level is rare or common in the corpus: a
first job counts the levels of all windows of all documents, and a level's rank is its place
from the rarest on. Among every ``SPREAD`` neighbouring windows of a text the one of lowest rank
(the first of equals) gets a vote; windows with ``VOTES`` or more are the text's features. They are
hashed into Bloom filters of 2,048 bits with five bits each (very short texts have short windows, and
all of them count); a filter takes ``FILL`` features,
then the next one in the chain begins. Two digests are alike as far as the filters of the shorter
chain overlap with their best match in the other, less what chance makes overlap.

Entropies of all windows are updated byte by byte in thousands of text segments at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.frames import chunks, map_texts, partitions_for, ragged, texts_of
from paperlake.llm.hashes import StretchHashes

WINDOW = 64
SPREAD = 64
VOTES = 16
FILL = 160
#: Texts of fewer characters are too short to choose from: all their windows of 8 bytes are features.
SHORT = 256
SHORT_WINDOW = 8
FILTER_BITS = 2048
HASHES = 5
LEVELS = 1000
CHUNK_BYTES = 2 << 20
_SEGMENT = 1024
_SCALE = 1 << 16
_N = np.arange(WINDOW + 2)
_PLOGP = np.round(_N * np.log2(np.maximum(_N, 1)) * _SCALE).astype(np.int64)
_LESS = np.concatenate(([0], _PLOGP[:-1] - _PLOGP[1:]))  # change when a count of n loses one
_MORE = np.append(_PLOGP[1:] - _PLOGP[:-1], 0)  # change when a count of n gains one


def levels_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy level of every window of every text, text after text; and windows per text.

    0 is the highest entropy (all bytes differ), LEVELS the lowest (all bytes equal).
    """
    windows = np.maximum(lengths - WINDOW + 1, 0)
    pieces = -(-windows // _SEGMENT)
    number = ragged(np.zeros(len(pieces), np.int64), pieces)
    first = np.repeat(starts, pieces) + number * _SEGMENT
    size = np.minimum(np.repeat(windows, pieces) - number * _SEGMENT, _SEGMENT)
    target = np.repeat(np.cumsum(windows) - windows, pieces) + number * _SEGMENT
    order = np.argsort(-size, kind="stable")
    first, size, target = first[order], size[order], target[order]
    out = np.zeros(int(windows.sum()), np.int16)
    if not len(out):
        return out, windows
    step = 4096  # segments side by side
    for a in range(0, len(first), step):
        _levels_of_segments(data, first[a : a + step], size[a : a + step], target[a : a + step], out)
    return out, windows


def _levels_of_segments(data, first, size, target, out) -> None:
    many, longest = len(first), int(size[0])
    padded = np.minimum(first[None, :] + np.arange(longest + WINDOW - 1)[:, None], len(data) - 1)
    cells = data[padded].astype(np.int32) + (np.arange(many, dtype=np.int32) * 256)[None, :]
    counts = np.bincount(cells[:WINDOW].ravel(), minlength=many * 256).astype(np.uint8)
    total = _PLOGP[counts.reshape(many, 256)].sum(axis=1)
    made = np.empty((longest, many), np.int64)
    made[0] = total
    live = np.searchsorted(-size, -np.arange(longest), side="left")  # segments longer than t
    for t in range(1, longest):
        k = int(live[t])
        gone, come, now = cells[t - 1, :k], cells[t + WINDOW - 1, :k], total[:k]
        n = counts[gone]
        now += _LESS[n]
        counts[gone] = n - 1
        n = counts[come]
        now += _MORE[n]
        counts[come] = n + 1
        made[t, :k] = now
    values = (made * LEVELS // int(_PLOGP[WINDOW])).astype(np.int16)
    out[ragged(target, size)] = values.T[np.arange(longest)[None, :] < size[:, None]]


class Texts:
    """Texts behind each other."""

    def __init__(self, texts: list[bytes]) -> None:
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(texts), np.uint8)


def level_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all documents have each entropy level (LEVELS + 1 numbers)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for part in chunks(texts_of(batch.column(0)), CHUNK_BYTES):
                own = Texts(part)
                if own.lengths.max() >= WINDOW:
                    total += np.bincount(levels_of(own.data, own.starts, own.lengths)[0], minlength=LEVELS + 1)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["level", "n"])

    rows = docs.select("text").mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LEVELS + 1, np.int64)
    for row in rows:
        out[row["level"]] = row["n"]
    return out


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of every level: 0 is the rarest."""
    ranks = np.empty(len(counts), np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    return ranks


def digests(texts: list[bytes], ranks: np.ndarray) -> list[bytes]:
    """Chain of Bloom filters of every text; texts without bytes have none."""
    return [d for part in chunks(texts, CHUNK_BYTES) for d in _digests(part, ranks)]


def _digests(texts: list[bytes], ranks: np.ndarray) -> list[bytes]:
    own = Texts(texts)
    if not len(own.data):
        return [b""] * len(texts)
    hashes = StretchHashes(own.data)
    sums = np.concatenate(([0], np.cumsum((own.data & 0xC0) != 0x80)))
    short = sums[own.starts + own.lengths] - sums[own.starts] < SHORT
    level, windows = levels_of(own.data, own.starts, np.where(short, 0, own.lengths))
    first = np.cumsum(windows) - windows
    n = len(level)
    long = np.flatnonzero(~short)
    of, start = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(long):
        rank = (ranks[level] << 32) | np.arange(n)
        low, width = rank, 1
        while width < SPREAD:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        votes = np.bincount(low[ragged(first[long], windows[long] - SPREAD + 1)] & 0xFFFFFFFF, minlength=n)
        need = np.minimum(np.maximum.reduceat(votes, first[long]), VOTES)
        chosen = np.flatnonzero(votes >= np.repeat(need, windows[long]))
        of = long[np.searchsorted(first[long], chosen, side="right") - 1]
        start = own.starts[of] + chosen - first[of]
    brief = np.flatnonzero(short & (own.lengths > 0))
    each = np.maximum(own.lengths[brief] - SHORT_WINDOW + 1, 1)
    size = np.concatenate([np.full(len(start), WINDOW), np.repeat(np.minimum(own.lengths[brief], SHORT_WINDOW), each)])
    start = np.concatenate([start, ragged(own.starts[brief], each)])
    of = np.concatenate([of, np.repeat(brief, each)])
    value = hashes.hash(start, size)
    by = np.lexsort((np.arange(len(of)), value, of))
    fresh = np.ones(len(by), bool)
    fresh[1:] = (of[by][1:] != of[by][:-1]) | (value[by][1:] != value[by][:-1])
    keep = np.sort(by[fresh])
    keep = keep[np.argsort(of[keep], kind="stable")]
    of, value = of[keep], value[keep]
    per_text = np.bincount(of, minlength=len(texts))
    place = np.arange(len(of)) - (np.cumsum(per_text) - per_text)[of]
    filters = -(-per_text // FILL)
    base = np.cumsum(filters) - filters
    bits = np.zeros(int(filters.sum()) * FILTER_BITS, bool)
    at = (base[of] + place // FILL) * FILTER_BITS
    for k in range(HASHES):
        bits[at + ((value >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits).tobytes()
    size = FILTER_BITS // 8
    return [packed[b * size : (b + f) * size] for b, f in zip(base.tolist(), filters.tolist(), strict=True)]


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: overlap of two digests beyond chance. Two empty ones are alike, one is not."""
    if not a or not b:
        return float(a == b)
    if len(a) > len(b):
        a, b = b, a
    x, y = (np.frombuffer(d, np.uint64).reshape(-1, FILTER_BITS // 64) for d in (a, b))
    ones_x, ones_y = (np.bitwise_count(v).sum(axis=1, dtype=np.int64) for v in (x, y))
    total = 0.0
    for row, ones in zip(x, ones_x, strict=True):
        both = np.bitwise_count(row & y).sum(axis=1, dtype=np.int64)
        chance = ones * ones_y / FILTER_BITS
        best = np.minimum(ones, ones_y)
        total += float(np.clip((both - chance) / np.maximum(best - chance, 1e-9), 0, 1).max())
    return total / len(x)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``found.digest``, the chain of filters, of every document.

    Null and empty texts have an empty digest; equal texts have equal ones; a text of less than
    one short window is one feature.
    """
    ranks = ranks_of(level_counts(docs))
    return map_texts(docs, "digest binary", lambda texts: [pa.array(digests(texts, ranks), pa.binary())])


def against_next(docs: DataFrame) -> DataFrame:
    """Digests of every document and of its edited text, and how alike it is to that and to the next.

    Next is by descending ``doc_id`` (null last; rows of one id by text; after the last comes the
    first). The edited text ends in the next one's first characters in place of its own last third.

    Rows are dealt into ranges of ``doc_id`` and sorted there; each range also gets a copy of the
    first row of the range behind it, so no window spans the table.
    """
    ranks = ranks_of(level_counts(docs))
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    partitions = partitions_for(docs)
    wanted = 4 * partitions
    bounds = rows.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [k / wanted for k in range(1, wanted)], 0.0005)
    splits = [float("-inf"), *sorted(set(bounds) or {0.0}), float("inf")]
    ranged = (
        Bucketizer(splits=splits, inputCol="_at", outputCol="range", handleInvalid="keep")
        .transform(rows.withColumn("_at", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan")))))
        .select(F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("range").cast("int")).alias("range"), "doc_id", "text")
    )
    firsts = ranged.groupBy("range").agg(F.max("doc_id").alias("doc_id")).orderBy(F.desc("range")).collect()
    before = [firsts[-1], *firsts[:-1]] if firsts else []
    heads = spark.createDataFrame(
        [(f["range"], f["doc_id"], b["range"]) for f, b in zip(firsts, before, strict=True)], f"range int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, to int"
    )  # a row per range
    same = [ranged["range"] == heads["range"], ranged["doc_id"].eqNullSafe(heads["doc_id"])]
    guests = ranged.join(F.broadcast(heads), same).groupBy("to").agg(F.min("text").alias("text"))
    both = ranged.withColumn("guest", F.lit(False)).unionByName(
        guests.select(F.col("to").alias("range"), F.lit(True).alias("guest"), "text"), allowMissingColumns=True
    )
    ordered = both.repartition(partitions, "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "digest", "edited_digest", "near_edited", "near_next"]
    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, digest binary, edited_digest binary, near_edited double, near_next double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: range, doc_id, text, digest
        for batch in batches:
            kind = batch.column(1).type
            size = 0
            part: list[tuple] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                part.append(row)
                size += len(row[2])
                if size >= CHUNK_BYTES:
                    out, held = pairs(part, held, kind)
                    yield out
                    part, size = [], 0
            if part:
                out, held = pairs(part, held, kind)
                yield out

    def pairs(part: list[tuple], held, kind: pa.DataType):
        own = digests([r[2].encode() for r in part], ranks)
        chain = ([held] if held else []) + [(r[0], r[1], r[2], r[3], d) for r, d in zip(part, own, strict=True)]
        linked = [(a, b) for a, b in zip(chain, chain[1:], strict=False) if not a[3] and a[0] == b[0]]
        edited = [a[2][: len(a[2]) - len(a[2]) // 3] + b[2][: len(a[2]) // 3] for a, b in linked]
        raw = [e.encode() for e in edited]
        theirs = digests(raw, ranks)
        columns = [
            pa.array([a[1] for a, _ in linked], kind),
            pa.array([len(a[2]) for a, _ in linked], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in raw], pa.string()),
            pa.array([a[4] for a, _ in linked], pa.binary()),
            pa.array(theirs, pa.binary()),
            pa.array([likeness(a[4], d) for (a, _), d in zip(linked, theirs, strict=True)], pa.float64()),
            pa.array([likeness(a[4], b[4]) for a, b in linked], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names), chain[-1]

    return ordered.select("range", "doc_id", "text", "guest").mapInArrow(run, schema)
