import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.llm import decontaminate, queries


def slow(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = {}
    for name, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add("" if name is None else str(name))
    out = []
    for i, text in docs:
        w, hit, seen = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    seen |= windows[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_query_is_brute_force(spark, folder, texts, duck):
    items = duck.sql("select item_id, text from benchmark").fetchall()
    assert sorted(map(tuple, queries.op2_decontaminate(spark, folder).collect()), key=str) == slow(texts, items)


@pytest.mark.parametrize("block_bytes, shard_bytes", [(1 << 20, 1 << 20), (4, 8)])
def test_short_items_and_odd_rows(spark, block_bytes, shard_bytes):
    docs = [(1, "a b c a b c a b c"), (2, None), (3, ""), (4, "x a b y b c"), (5, "c"), (6, "Ä b ä"), (None, "a b"), (7, "n " * 30), (7, "n " * 30)]
    items = [(1, "A b"), (2, "b c"), (3, None), (4, ""), (10, "ä"), (4, "b c"), (11, "n " * 14), (None, "y")]
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("found", F.lit(1)),
        spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes, shard_bytes=shard_bytes,
    )
    got = found.select(
        "row.doc_id", "found.n_words", "found.n_hit", F.size("found.items"), F.sha2(F.array_join("found.items", ","), 256), "found.contaminated"
    ).collect()
    assert sorted(map(tuple, got), key=str) == slow(docs, items)


def test_empty_tables(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.contamination(odd, none)
    assert found.where("found.n_hit > 0 or found.contaminated").count() == 0 and found.count() == odd.count()
    assert found.select("row.*").columns == odd.columns
    assert decontaminate.contamination(odd.limit(0), none).count() == 0


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    symbols = rng.integers(1, 6, 2000)
    index = decontaminate.FMIndex(symbols, 5)
    phrases = np.array([symbols[k : k + 4] for k in range(0, 1990, 7)] + [[5, 5, 5, 5], [1, 2, 3, 4]])
    low, high = index.ranges(phrases)
    for phrase, a, b in zip(phrases, low, high, strict=True):
        want = [k for k in range(len(symbols) - 3) if (symbols[k : k + 4] == phrase).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
