"""Benchmark decontamination: an FM-index over every shard of the training texts.

Symbols are words. A word that no test phrase has can be in no occurrence, so all such words
are one separator, and stretches between separators that are shorter than the shortest phrase
are left out. Over the rest each task builds, per shard, a suffix array, its Burrows-Wheeler
transform, a wavelet tree with blocked ranks and the suffix positions at every ``SAMPLE``-th
place. Test phrases are searched backwards, all at once; occurrences are located by walking to
the next sampled position, and their word spans are merged per document.

Test phrases come to the tasks in blocks of bounded size, one pass after the other over rows
that stay where they are: nothing is shuffled, however large either table is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.frames import ALNUM, map_texts, ragged
from paperlake.llm.suffixes import packed_symbols, suffix_array

WINDOW = 13
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20
SAMPLE = 16


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class WaveletTree:
    """Levelwise wavelet tree: bits of a sequence from the highest down, with blocked ranks."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels = []
        n = len(symbols)
        for level in range(bits - 1, -1, -1):
            ones = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(np.append(ones, np.zeros(-n % 64 + 64, bool)), bitorder="little").view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed).astype(np.int64))))
            zeros = n - int(ones.sum())
            self.levels.append((level, packed, before, zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``at`` symbols; both are arrays."""
        low = np.zeros(len(at), np.int64)
        for level, packed, before, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            low_ones, at_ones = _ones(packed, before, low), _ones(packed, before, at)
            low = np.where(one, zeros + low_ones, low - low_ones)
            at = np.where(one, zeros + at_ones, at - at_ones)
        return at - low


def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    word, rest = at >> 6, (at & 63).astype(np.uint64)
    mask = (np.uint64(1) << rest) - np.uint64(1)
    return before[word] + np.bitwise_count(packed[word] & mask).astype(np.int64)


class FMIndex:
    """Index of a sequence of symbols of at least 1."""

    def __init__(self, symbols: np.ndarray, size: int, sample: int = SAMPLE) -> None:
        symbols = np.append(symbols, 0)  # a last symbol of its own
        bits = max(1, int(size).bit_length())
        order = suffix_array(*packed_symbols(symbols, bits))
        self.last = symbols[order - 1]
        self.tree = WaveletTree(self.last, bits)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size + 1))))
        marked = order % sample == 0
        self.marked, self.sampled, self.row = marked, order[marked], np.cumsum(marked) - 1
        self.n = len(symbols)

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end row of the suffixes that begin with each phrase (a row of symbols)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            low[live] = self.smaller[c] + self.tree.rank(c, low[live])
            high[live] = self.smaller[c] + self.tree.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        found = np.full(len(rows), -1, np.int64)
        live, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            here = self.marked[at]
            found[live[here]] = self.sampled[self.row[at[here]]] + steps
            live, at = live[~here], at[~here]
            c = self.last[at]
            at = self.smaller[c] + self.tree.rank(c, at)
            steps += 1
        return found


@dataclass
class Phrases:
    """Windows of a block of test items."""

    items: list[str]
    numbers: dict[bytes, int]  # word -> symbol, from 2 on; 1 separates
    by_length: list[tuple[np.ndarray, list[np.ndarray]]]  # phrases, and the items of each
    shortest: int


def phrases_of(items: list[tuple[str, bytes]], window: int = WINDOW) -> Phrases:
    numbers: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[int]] = {}
    names: list[str] = []
    for name, text in items:
        words = [numbers.setdefault(w, len(numbers) + 2) for w in words_of(text)]
        if words:
            names.append(name)
            for k in range(max(1, len(words) - window + 1)):
                found.setdefault(tuple(words[k : k + window]), set()).add(len(names) - 1)
    by_length = []
    for length in sorted({len(p) for p in found}):
        own = [p for p in found if len(p) == length]
        by_length.append((np.array(own, np.int64), [np.array(sorted(found[p])) for p in own]))
    return Phrases(names, numbers, by_length, min((p.shape[1] for p, _ in by_length), default=0))


def search(texts: list[bytes], phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Words, merged word spans of occurrences and items of every text of a shard."""
    get = phrases.numbers.get
    counts, parts = [], []
    for text in texts:
        found = words_of(text)
        counts.append(len(found))
        parts.append(np.fromiter((get(w, 0) for w in found), np.int64, len(found)))
        parts.append(np.zeros(1, np.int64))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if not phrases.by_length:
        return counts, spans, items
    symbols = np.concatenate(parts)
    known = np.concatenate(([False], symbols > 0, [False]))
    edges = np.flatnonzero(known[1:] != known[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    long = lengths >= phrases.shortest
    starts, lengths = starts[long], lengths[long]
    if not len(starts):
        return counts, spans, items
    place = ragged(starts, lengths + 1)  # with the separator behind
    index = FMIndex(np.maximum(symbols[place], 1), len(phrases.numbers) + 1)
    first_word = np.cumsum(np.array(counts) + 1) - (np.array(counts) + 1)
    hit = np.zeros(len(symbols) + 1, np.int64)
    seen: set[tuple[int, int]] = set()
    for own, of_items in phrases.by_length:
        low, high = index.ranges(own)
        there = np.flatnonzero(high > low)
        if not len(there):
            continue
        which = np.repeat(there, (high - low)[there])
        at = place[index.locate(ragged(low[there], (high - low)[there]))]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + own.shape[1], -1)
        docs = np.searchsorted(first_word, at, side="right") - 1
        pairs = np.unique(np.stack([which, docs], axis=1), axis=0)
        seen.update((int(d), int(i)) for p, d in pairs for i in of_items[p])
    covered = np.concatenate(([False], np.cumsum(hit)[:-1] > 0, [False]))
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        d = int(np.searchsorted(first_word, a, side="right")) - 1
        spans[d].append((a - int(first_word[d]), b - int(first_word[d])))
    for d, i in sorted(seen):
        items[d].append(phrases.items[i])
    return counts, spans, items


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``found`` of every document.

    ``found`` has ``n_words``, ``spans`` (merged ``start`` and ``stop`` word positions that lie in
    occurrences), ``items`` (distinct ids, as strings, sorted), ``n_hit`` and ``contaminated``.
    Null texts have no words. Items without words have no windows; a null item_id counts as
    the empty string; repeated items count once by id. With an empty benchmark nothing is hit.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    fields = "n_words long, spans array<struct<start:int,stop:int>>, items array<string>"
    result = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast([(r["id"], r["text"].encode()) for r in own])

        def run(texts: list[bytes], shared=shared, built=[]) -> list[pa.Array]:  # noqa: B006  built once per task
            if not built:
                built.append(phrases_of(shared.value, window))
            counts, spans, found = search(texts, built[0])
            span_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            as_rows = [[{"start": a, "stop": b} for a, b in s] for s in spans]
            return [pa.array(counts, pa.int64()), pa.array(as_rows, span_type), pa.array(found, pa.list_(pa.string()))]

        if result is None:
            result = map_texts(docs, fields, run, chunk_bytes=shard_bytes)
        else:
            inner = result.select(F.col("row.text").alias("text"), F.struct("row", "found").alias("before"))
            result = map_texts(inner, fields, run, chunk_bytes=shard_bytes).select(
                F.col("row.before.row").alias("row"),
                F.struct(
                    F.col("found.n_words").alias("n_words"),
                    F.concat("row.before.found.spans", "found.spans").alias("spans"),
                    F.concat("row.before.found.items", "found.items").alias("items"),
                ).alias("found"),
            )
    spans = merged(F.col("found.spans")) if blocks > 1 else F.col("found.spans")
    hits = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["start"]))
    return result.select(
        "row",
        F.struct(F.col("found.n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct("found.items")).alias("items"), hits.alias("n_hit")).alias("found"),
    ).withColumn("found", F.col("found").withField("contaminated", (F.col("found.n_hit") > 0) & (20 * F.col("found.n_hit") >= F.col("found.n_words"))))


def merged(spans):
    """Overlapping spans of an array made one."""
    kind = "array<struct<start:int,stop:int>>"

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(
            F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))),
        )
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= span["start"]), joined).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)
