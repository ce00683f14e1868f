"""Removal of byte strings that occur twice: suffix arrays per shard, merged across shards.

Every byte inside a ``LENGTH``-byte string that also starts anywhere else goes.

1. Texts of equal content meet nowhere: a text that occurs in two rows is wholly repeated (or too
   short), so one of its rows stands for it and the others are answered without their text.
2. Texts are dealt to shards of about ``SHARD_BYTES`` by a hash of their content, once.
3. Anchors: positions of the smallest 8-byte hash among ``SPREAD`` neighbours. Which position
   is smallest follows from the bytes alone, so two equal strings of 200 bytes share at least
   three anchors in a row. A key is the hash of the text from an anchor to the second next;
   keys that occur once in the corpus rule out every string around them. Sorted keys of all shards
   are merged per key range by binary search.
4. What is left of a shard gets a suffix array (Larsson-Sadakane) and common prefixes (Kasai).
   Neighbours that share 200 bytes or more are repeats inside the shard; one digest per different
   string goes to the merge across shards, again sorted runs and binary search.
5. Every shard marks its repeated strings, unites them into spans and cuts them.

A digest has 64 bits (random multipliers per byte value): among 10 ** 9 different strings the
chance that any two agree is below 3 %. Key ranges hold few bytes each while a shard has
many keys per range; above about 1 TB of text give larger ``shard_bytes``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.frames import freed, partitions_for, ragged
from paperlake.llm.hashes import StretchHashes
from paperlake.llm.suffixes import previous_common, suffix_array, words8

LENGTH = 200
#: A task holds about 120 bytes for each byte of its shard.
SHARD_BYTES = 2 << 20
GRAM = 8
#: LENGTH - GRAM + 1 positions hold three anchors if no two of them are further apart.
SPREAD = 64
MOST_RANGES = 2048


class Shard:
    """Distinct texts of a shard behind each other, with hashes of any stretch."""

    def __init__(self, table: pa.Table) -> None:
        keys = table["key"].to_pylist()
        order = sorted({k: i for i, k in reversed(list(enumerate(keys)))}.items())
        self.keys = [k for k, _ in order]
        self.rows = [i for _, i in order]
        texts = table["text"].cast(pa.binary()).take(pa.array(self.rows, pa.int64())).to_pylist()
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.hashes = StretchHashes(self.data)
        self.hash = self.hashes.hash

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Stretches from an anchor to the second next one: hash, start, stop, text."""
        n = len(self.data)
        low = self.hashes.everywhere(GRAM)
        low &= np.uint64(0xFFFFFFFF00000000)
        low |= np.arange(n, GRAM - 1, -1, dtype=np.uint64)  # n - position: of equal ones the last is smaller
        width = 1
        while width < SPREAD:  # smallest of the next 2, 4, ... positions
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        within = np.ones(len(low), bool)  # windows that do not reach into the next text
        reach = GRAM + SPREAD - 2
        ends = self.starts + self.lengths
        across = ragged(ends - reach, np.full(len(ends), reach))
        within[across[across < len(low)]] = False
        chosen = np.zeros(n, bool)
        chosen[n - (low[within] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
        anchors = np.flatnonzero(chosen)
        text = np.searchsorted(self.starts, anchors, side="right") - 1
        whole = np.flatnonzero(text[2:] == text[:-2]) if len(anchors) > 2 else np.empty(0, np.int64)
        start, stop = anchors[whole], anchors[whole + 2] + GRAM
        return self.hash(start, stop - start), start, stop, text[whole]

    def candidates(self, repeated: np.ndarray, start, stop, text) -> np.ndarray:
        """Starts of all strings around repeated phrases."""
        first = np.maximum(self.starts[text], stop - LENGTH)[repeated]
        last = np.minimum(start, self.starts[text] + self.lengths[text] - LENGTH)[repeated]
        fits = last >= first
        size = len(self.data) + 1
        marks = np.bincount(first[fits], minlength=size) - np.bincount(last[fits] + 1, minlength=size)
        return np.flatnonzero(np.cumsum(marks[:-1]) > 0)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Of every byte whether it is in one of the strings; no start comes twice."""
        marks = np.zeros(len(self.data) + 1, np.int32)
        marks[starts] += 1
        marks[starts + LENGTH] -= 1
        return np.cumsum(marks[:-1]) > 0

    def repeats_inside(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One start of every different string, and whether it starts twice in this shard."""
        place = np.flatnonzero(self.covered(starts))
        part = self.data[place]
        eight = words8(part)
        order = suffix_array(eight, 8, LENGTH)
        shared = previous_common(part, order, eight, LENGTH)[order]
        group = np.cumsum(shared < LENGTH)
        valid = np.zeros(len(self.data), bool)
        valid[starts] = True
        kept = valid[place[order]]
        at, group = place[order[kept]], group[kept]
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, np.int64)
        sizes = np.diff(np.append(heads, len(group)))
        return at[heads], sizes > 1


def runs(shard: int, values: np.ndarray, twice: np.ndarray, ranges: int) -> pa.Table:
    """Sorted different values of a shard, one row per range; ``twice`` marks those it has twice."""
    values, at = np.unique(values, return_inverse=True)
    counts = np.bincount(at, minlength=len(values)) > 1
    counts |= np.bincount(at, weights=twice, minlength=len(values)) > 0
    of = range_of(values, ranges)
    numbers, firsts = np.unique(of, return_index=True)
    cuts = [*firsts.tolist(), len(values)]
    return pa.table({
        "shard": pa.array(np.full(len(numbers), shard, np.int64)),
        "range": pa.array(numbers.astype(np.int32)),
        "data": pa.array([deltas(values[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
        "twice": pa.array([np.packbits(counts[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
    })


def range_of(values: np.ndarray, ranges: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def deltas(values: np.ndarray) -> bytes:
    """Sorted values as differences, byte by byte of equal weight, so that blocks compress."""
    steps = np.diff(values, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def undone(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0]
    return np.cumsum(steps)


def merge(table: pa.Table) -> pa.Table:
    """For every run of a range: which of its values this or any other run has a second time."""
    found = [undone(d) for d in table["data"].to_pylist()]
    everything = np.sort(np.concatenate(found))
    out = []
    for values, bits in zip(found, table["twice"].to_pylist(), strict=True):
        own = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(values)).astype(bool)
        next_ = np.searchsorted(everything, values) + 1
        other = everything[np.minimum(next_, len(everything) - 1)] == values
        out.append(np.packbits(own | (other & (next_ < len(everything)))).tobytes())
    return pa.table({"shard": table["shard"], "range": table["range"], "bits": pa.array(out, pa.binary())})


def flags(side: pa.Table, kind: int, values: np.ndarray, ranges: int) -> np.ndarray:
    """Of every value whether the merge found it twice."""
    if not len(values):
        return np.zeros(0, bool)
    distinct, at = np.unique(values, return_inverse=True)
    of = range_of(distinct, ranges)
    out = np.zeros(len(distinct), bool)
    told = {r: b for k, r, b in zip(side["kind"].to_pylist(), side["range"].to_pylist(), side["bits"].to_pylist(), strict=True) if k == kind}
    numbers, firsts = np.unique(of, return_index=True)
    cuts = [*firsts.tolist(), len(distinct)]
    for number, a, b in zip(numbers.tolist(), cuts, cuts[1:], strict=False):
        out[a:b] = np.unpackbits(np.frombuffer(told[number], np.uint8), count=b - a).astype(bool)
    return out[at]


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_bytes``, ``spans`` and ``kept`` of every document.

    ``spans`` are the maximal removed runs (``start``, ``stop`` in bytes of the input), ``kept`` the
    other bytes. Null and empty texts have no bytes; texts under 200 bytes stay whole; repeated
    rows of longer texts lose all bytes. An empty table gives no rows. ``row.text`` is null here
    where the text had to move: ``kept`` has what stays of it.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fields = [F.lit(None).cast(f.dataType).alias(f.name) if f.name == "text" else F.col(f"`{f.name}`") for f in docs.schema]
    spans_type = "array<struct<start:long,stop:long>>"
    told = docs.select(F.struct(*fields).alias("row"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    short = told.where(F.col("n_bytes") < LENGTH).select("row", "n_bytes", F.array().cast(spans_type).alias("spans"), F.col("text").cast("binary").alias("kept"))
    long = told.where(F.col("n_bytes") >= LENGTH).withColumn("key", F.unhex(F.sha2("text", 256)))
    total = long.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    partitions = partitions_for(docs)
    ranges = min(MOST_RANGES, max(partitions, shards))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")

    info = long.select("row", "n_bytes", "key")
    copied = info.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    whole = info.join(copied, "key", "left_semi").select(
        "row", "n_bytes", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))).alias("spans"), F.lit(b"").alias("kept")
    )

    def one_each(batches):
        seen: set[bytes] = set()  # of one input split
        for batch in batches:
            keys = batch.column(1).to_pylist()
            new = [not (k in seen or seen.add(k)) for k in keys]
            yield batch.filter(pa.array(new, pa.bool_()))

    row_type = told.schema["row"].dataType.simpleString()
    dealt = (
        long.select(shard, "key", "row", "text")
        .mapInArrow(one_each, f"shard long, key binary, row {row_type}, text string")
        .repartition(partitions, "shard")
    )
    side_type = "shard long, range int, data binary, twice binary"

    def keys(table: pa.Table) -> pa.Table:
        values, *_ = Shard(table).phrases()
        return runs(table["shard"][0].as_py(), values, np.zeros(len(values), bool), ranges)

    def strings(table: pa.Table, side: pa.Table) -> pa.Table:
        own = Shard(table) if table.num_rows else None
        starts = _candidates(own, side, ranges) if own else np.empty(0, np.int64)
        if not len(starts):
            return runs(0, np.empty(0, np.uint64), np.empty(0, bool), ranges)
        heads, twice = own.repeats_inside(starts)
        return runs(table["shard"][0].as_py(), own.hash(heads, LENGTH), twice, ranges)

    def cut(table: pa.Table, side: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"row": table["row"], "n_bytes": pa.array([], pa.int64()), "spans": pa.array([], span_list), "kept": pa.array([], pa.binary())})
        own = Shard(table)
        starts = _candidates(own, side, ranges)
        starts = starts[flags(side, 1, own.hash(starts, LENGTH), ranges)]
        gone = own.covered(starts)
        copies = {b for k, b in zip(side["kind"].to_pylist(), side["bits"].to_pylist(), strict=True) if k == 2}
        which = [i for i, k in enumerate(own.keys) if k not in copies]
        spans, kept = [], []
        for i in which:
            a, b = int(own.starts[i]), int(own.starts[i] + own.lengths[i])
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone[a:b], [False])))).tolist()
            spans.append([{"start": x, "stop": y} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(own.data[a:b][~gone[a:b]].tobytes() if edge else own.data[a:b].tobytes())
        return pa.table({
            "row": table["row"].take(pa.array([own.rows[i] for i in which], pa.int64())),
            "n_bytes": pa.array(own.lengths[which].astype(np.int64)),
            "spans": pa.array(spans, span_list),
            "kept": pa.array(kept, pa.binary()),
        })

    span_list = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    by_shard = dealt.groupBy("shard")
    merged = "shard long, range int, bits binary"
    told_keys = by_shard.applyInArrow(freed(keys), side_type).groupBy("range").applyInArrow(freed(merge), merged).select("shard", F.lit(0).alias("kind"), "range", "bits")
    found = by_shard.cogroup(told_keys.groupBy("shard")).applyInArrow(freed(strings), side_type)
    told_strings = found.groupBy("range").applyInArrow(freed(merge), merged).select("shard", F.lit(1).alias("kind"), "range", "bits")
    copy_keys = copied.select(shard, F.lit(2).alias("kind"), F.lit(0).alias("range"), F.col("key").alias("bits"))
    side = told_keys.unionByName(told_strings).unionByName(copy_keys)
    single = by_shard.cogroup(side.groupBy("shard")).applyInArrow(freed(cut), f"row {row_type}, n_bytes long, spans {spans_type}, kept binary")
    return short.unionByName(whole).unionByName(single)


def _candidates(own: Shard, side: pa.Table, ranges: int) -> np.ndarray:
    values, start, stop, text = own.phrases()
    return own.candidates(flags(side, 0, values, ranges), start, stop, text)
