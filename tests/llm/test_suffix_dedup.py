import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.llm import queries, suffix_dedup, suffixes


def slow(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[k : k + 200] for _, b in data for k in range(len(b) - 199))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if counts[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
        out.append((i, len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def test_query_is_brute_force(spark, folder, texts):
    assert sorted(map(tuple, queries.op7_suffix_dedup(spark, folder).collect()), key=str) == slow(texts)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 500])
def test_repeats_of_all_kinds(spark, shard_bytes):
    random.seed(3)
    some = lambda n: "".join(random.choice("ab cdé") for _ in range(n))
    p, u = some(210), "x" * 1000
    rows = [
        (1, None), (2, ""), (3, "a" * 199), (4, "b" * 200), (5, "c" * 201), (6, p + some(300)), (7, some(100) + p), (8, some(50) + p[:200] + some(50)),
        (9, p[5:205]), (10, u + some(20)), (11, p), (11, p), (12, "a" * 200), (13, "xy" * 300), (14, some(199)), (None, some(5) + p[3:203]), (15, (some(190) + "q") * 3),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("kept", F.lit(2))
    found = suffix_dedup.remove_repeats(docs, shard_bytes)
    got = found.select("row.doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"), F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == slow(rows)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(5)
    for alphabet in (1, 2, 4):
        data = np.concatenate([rng.integers(97, 97 + alphabet, 300), np.tile(rng.integers(97, 99, 37), 5)]).astype(np.uint8)
        eight = suffixes.words8(data)
        order = suffixes.suffix_array(eight, 8)
        raw = data.tobytes()
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:]) or alphabet == 1
        shared = suffixes.previous_common(data, order, eight, 50)
        for a, b in zip(order[:-1], order[1:], strict=True):
            n = next((k for k in range(len(raw)) if a + k >= len(raw) or b + k >= len(raw) or raw[a + k] != raw[b + k]), 0)
            assert min(shared[b], 50) == min(n, 50)


def test_merge_marks_values_of_several_runs():
    runs = [np.array([3, 1 << 40, 1 << 63], np.uint64), np.array([5, 1 << 40], np.uint64), np.array([5, 7], np.uint64)]
    tables = [suffix_dedup.runs(k, v, np.array([False] * (len(v) - 1) + [k == 2]), 1) for k, v in enumerate(runs)]
    import pyarrow as pa

    merged = suffix_dedup.merge(pa.concat_tables(tables))
    bits = [np.unpackbits(np.frombuffer(b, np.uint8))[: len(v)].tolist() for b, v in zip(merged["bits"].to_pylist(), runs, strict=True)]
    assert bits == [[0, 1, 0], [1, 1], [1, 1]]
