"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint holds the majority of every bit over the XXH64 values (seed 42) of a text's
word shingles. Two fingerprints link at ``radius`` or fewer differing bits.

Candidates come from ``2 ** (radius + 1) - 1`` tables. Every bit position i has a vector
a(i) of ``radius + 1`` bits; table v keeps the bits with odd <a(i), v>. For any ``radius``
positions some v is orthogonal to all their vectors, so two fingerprints that differ in no
other positions agree in table v: no pair within the radius is lost, whatever the data.

Only distinct fingerprints are compared, so copies cost nothing. A bucket of n of them is
dealt by hash into blocks of ``BLOCK`` members and every pair of blocks is a group of its own;
a group returns a spanning forest of its links, never all pairs. No task holds a whole bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.components import components
from paperlake.llm.frames import LOWER, per_batch, texts_of
from paperlake.runtime import durable

SEED = 42
WORDS = 3
RADIUS = 3
BITS = 64
#: Members of a block; a group compares at most this many with as many.
BLOCK = 512
#: Shingles whose bits are counted at once.
_PIECE = 1 << 16


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Fingerprint of a UTF-8 text; 0 without a word."""
    found = text.translate(LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        shingles = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = np.concatenate(([0], ends[: -words] + 1))
        shingles = [joined[s:e] for s, e in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), _PIECE):
        hashes = b"".join([digest(s, SEED) for s in shingles[at : at + _PIECE]])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, BITS // 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, words: int = WORDS, text: str = "text") -> DataFrame:
    """Add ``simhash`` (long, the fingerprint's 64 bits). Null texts count as empty ones."""
    kept = [f.name for f in docs.schema if f.name not in (text, "simhash")]
    schema = docs.select(*kept).withColumn("simhash", F.lit(0).cast("long")).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, words) for t in texts_of(batch.column(0))], np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values.view(np.int64))], [*kept, "simhash"])

    return docs.select(text, *kept).mapInArrow(per_batch(run), schema)


def masks(radius: int = RADIUS) -> list[int]:
    """Bit masks of the tables, as signed 64-bit numbers."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(BITS)]
    found = []
    for v in range(1, size + 1):
        mask = sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() % 2)
        found.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return found


def links(fingerprints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (``a``, ``b``) that connect all ``simhash`` values within ``radius`` of each other.

    ``fingerprints`` holds distinct values. The links have the same connected components as
    the graph of all such pairs, with far fewer edges in dense places.
    """
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("simhash").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks(radius))])
    keyed = fingerprints.select("simhash", F.inline(tables))
    shared = durable(
        keyed.groupBy("t", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("simhash").alias("a"), F.max("simhash").alias("b"))
        .where("n > 1"),
        "simhash-buckets",
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = shared.where((F.col("n") == 2) & near).select("a", "b")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("simhash"), F.col("blocks").cast("long")).cast("int")
    dealt = (
        keyed.join(shared.where("n > 2").select("t", "key", blocks.alias("blocks")), ["t", "key"])
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.struct("t", "key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")).alias("at"),
            (F.col("mine") <= F.col("other")).alias("left"),
            (F.col("mine") >= F.col("other")).alias("right"),
            "simhash",
        )
    )

    def compare(table: pa.Table) -> pa.Table:
        values = table["simhash"].to_numpy()
        a, b = forest(values[table["left"].to_numpy()], values[table["right"].to_numpy()], radius)
        return pa.table({"a": a, "b": b})

    return pairs.unionByName(dealt.groupBy("at").applyInArrow(compare, "a long, b long")).distinct()


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``radius`` between two sets of fingerprints, reduced to a spanning forest."""
    near = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= radius
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = np.nonzero(near)
    u, v = at[: len(left)][i], at[len(left) :][j]
    u, v = u[u != v], v[u != v]
    label = np.arange(len(nodes))
    while True:  # minimum labels with pointer jumping
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        low = low[low]
        if np.array_equal(low, label):
            break
        label = low
    inner = label != np.arange(len(nodes))
    return nodes[label[inner]], nodes[inner]


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``simhash``, ``component_id`` (the smallest doc_id that links reach) and ``label`` (a fingerprint of it).

    One row per row of ``docs``. Null and empty texts share fingerprint zero and link like any
    other. Null doc_ids get a row; they never are a component_id unless nothing else is there.
    An empty table gives no rows; other columns are not looked at.
    """
    prints = durable(with_fingerprint(docs.select("doc_id", "text"), words), "simhash")
    nodes = prints.groupBy("simhash").agg(F.min("doc_id").alias("first_id"))
    labels = components(links(nodes.select("simhash"), radius))
    reached = nodes.join(labels.select(F.col("node").alias("simhash"), "label"), "simhash", "left").select(
        "simhash", "first_id", F.coalesce("label", "simhash").alias("label")
    )
    lowest = reached.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_print = reached.join(lowest, "label").select("simhash", "component_id", "label")
    return prints.join(of_print, "simhash").select("doc_id", "simhash", "component_id", "label")


def keep_first(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """One document of every component: the row with its smallest doc_id (then any one text of that id).

    Rows with a null doc_id are kept only where their component has no other row.
    """
    found = near_duplicates(docs, radius, words)
    key = [F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", F.lit(0)).alias("_id"), "simhash"]
    firsts = found.groupBy("label").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    marked = with_fingerprint(rows, words).select("row", *key)
    names = ["_no_id", "_id", "simhash"]
    return marked.join(firsts, names, "left_semi").dropDuplicates(names).select("row.*")
