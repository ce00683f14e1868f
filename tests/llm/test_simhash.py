import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from paperlake.llm import queries, simhash
from paperlake.llm.components import components


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def classes(prints):
    """Smallest id reachable over pairs of at most three differing bits."""
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_query_is_brute_force(spark, folder, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3_simhash(spark, folder).collect()}
    prints = {i: slow_print(t) for i, t in texts}
    label = classes(prints)
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i, _ in texts}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_masks_cover_the_radius(value, flipped):
    other = value
    for bit in flipped:
        other ^= 1 << bit
    assert any((value & m) == (other & m) for m in (m % (1 << 64) for m in simhash.masks()))


def test_dense_bucket_keeps_every_link(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**62))
    values = {centre}
    while len(values) < 150:
        bits = rng.choice(64, size=rng.integers(0, 6), replace=False)
        values.add(centre ^ sum(1 << int(b) for b in bits))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "simhash long"), block=16)
    label = {r["node"]: r["label"] for r in components(found).collect()}
    groups = lambda of: {frozenset(k for k in signed if of(k) == g) for g in {of(k) for k in signed}}
    prints = {v: v % (1 << 64) for v in signed}
    want = classes(prints)
    assert groups(lambda k: label.get(k, k)) == groups(lambda k: want[k])


def test_long_chain_of_links(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    label = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert label == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = {r["doc_id"]: r["component_id"] for r in got if r["simhash"] == 0}
    assert zero == {5: 4, 4: 4, 8: 4}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["4", "3", "2", "1", "None", "9"])
    assert simhash.keep_first(odd.limit(0)).count() == 0
