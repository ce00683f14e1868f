import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from paperlake.llm import digest, queries


def test_levels_are_those_of_every_window():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(32, 32 + k, n, dtype=np.uint8)) for k, n in ((3, 64), (20, 3000), (1, 500), (26, 63), (5, 0), (9, 1100), (9, 1087), (150, 2112))]
    own = digest.Texts(texts)
    got, _ = digest.levels_of(own.data, own.starts, own.lengths)
    want = [
        sum(int(digest._PLOGP[n]) for n in Counter(t[k : k + 64]).values()) * digest.LEVELS // int(digest._PLOGP[64]) for t in texts for k in range(len(t) - 63)
    ]
    assert got.tolist() == want


def test_query_links_each_document_to_the_next(spark, folder, texts):
    got = {r["doc_id"]: r for r in queries.op10_digest(spark, folder).collect()}
    rows = sorted(texts, reverse=True)
    assert len(got) == len(rows)
    prints = {}
    for k, (i, text) in enumerate(rows):
        after, cut = rows[(k + 1) % len(rows)][1], len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert 0 <= got[i]["near_next"] <= 1
        if len(text) >= 256 and len(after) >= cut and text != after:
            assert got[i]["near_edited"] > 0.3
    near = np.mean([r["near_edited"] for r in got.values()]), np.mean([r["near_next"] for r in got.values()])
    assert near[0] > 0.6 and near[1] < 0.1


def test_every_document_is_compared_across_ranges(spark, texts):
    """Digests and likeness of the distributed run are those of a plain loop."""
    rows = texts[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = digest.ranks_of(digest.level_counts(docs))
    own = dict(zip([i for i, _ in rows], digest.digests([t.encode() for _, t in rows], ranks), strict=True))
    down = sorted((i for i, _ in rows), reverse=True)
    got = {r["doc_id"]: (bytes(r["digest"]), round(r["near_next"], 9)) for r in digest.against_next(docs).collect()}
    assert got == {i: (own[i], round(digest.likeness(own[i], own[down[(k + 1) % len(down)]]), 9)) for k, i in enumerate(down)}


def test_odd_rows(spark, odd):
    got = digest.against_next(odd)
    assert got.count() == odd.count()
    assert got.where("near_edited < 0 or near_edited > 1 or near_next < 0 or near_next > 1").count() == 0
    assert digest.fingerprints(odd).select("row.*").columns == odd.columns
    assert digest.fingerprints(odd).where(F.octet_length("found.digest") == 0).count() == 2
    assert digest.against_next(odd.limit(0)).count() == 0


def test_likeness():
    ranks = digest.ranks_of(np.arange(digest.LEVELS + 1))
    a, b, c = digest.digests([b"lorem ipsum dolor sit amet " * 3, b"lorem ipsum dolor sit amet " * 3, b""], ranks)
    assert digest.likeness(a, b) == 1 and digest.likeness(a, c) == 0 and digest.likeness(c, c) == 1
