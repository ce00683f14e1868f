"""Quality rules and likelihood ratios against a plain loop over words."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from paperlake.llm import quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = Counter(line for line in (text or "").split("\n") if WORD.search(line))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, sum(n - 1 for n in lines.values()), len(hit)


def slow_buckets(text):
    hashes = [xxhash.xxh64_intdigest(re.sub("[A-Z]+", lambda m: m[0].lower(), w).encode()) for w in WORD.findall(text or "")]
    mixed = [(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(hashes, hashes[1:])]
    return [h % quality_rules.BUCKETS for h in hashes] + [(m ^ (m >> 32)) % quality_rules.BUCKETS for m in mixed]


def slow(rows, trusted):
    """Scores of all texts, from counts of all texts."""
    raw, good = Counter(), Counter()
    for i, text in rows:
        found = slow_buckets(text)
        raw.update(found)
        if i is not None and i in trusted:
            good.update(found)
    size, n_raw, n_good = quality_rules.BUCKETS, sum(raw.values()), sum(good.values())
    p_raw = [(raw[k] + 1) / (n_raw + size) for k in range(size)]
    p_good = [p * (good[k] + quality_rules.PRIOR) / (n_good * p + quality_rules.PRIOR) for k, p in enumerate(p_raw)]
    whole = math.fsum(p_good)
    gain = [math.log(g / whole) - math.log(p) for g, p in zip(p_good, p_raw)]
    scores = []
    for _, text in rows:
        found = slow_buckets(text)
        scores.append(math.fsum(gain[k] for k in found) / len(found) if found else 0.0)
    return scores


def test_query_is_the_plain_loop(spark, folder, texts, duck):
    trusted = {r[0] for r in duck.sql("select doc_id from labels where quality > 0").fetchall()}
    got = {r["doc_id"]: r for r in queries.op12_quality_rules(spark, folder).collect()}
    assert len(got) == len(texts)
    for (i, text), score in zip(texts, slow(texts, trusted), strict=True):
        counts = slow_counts(text)
        assert tuple(got[i])[1:6] == counts, i
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert got[i]["base_failed"] == failed
        assert got[i]["score"] == pytest.approx(score, abs=1e-9)
        assert got[i]["kept"] == (not failed and got[i]["score"] >= quality_rules.CUT)


def test_good_documents_stay_and_bad_ones_go(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = queries.op12_quality_rules(spark, folder).join(labels, "doc_id").where("not base_failed")
    shares = {r["quality"]: r["kept"] for r in found.groupBy("quality").agg({"kept": "count"}).withColumnRenamed("count(kept)", "kept").collect()}
    kept = {r["quality"]: r["n"] for r in found.where("kept").groupBy("quality").count().withColumnRenamed("count", "n").collect()}
    assert kept[1] >= 0.999 * shares[1]
    assert kept.get(0, 0) <= 0.05 * shares[0]


@pytest.mark.parametrize("seed", range(3))
def test_counts_of_odd_texts(spark, seed):
    rng = np.random.default_rng(seed)
    alphabet = ["a", "b", "é", " ", "\n", "\t", "\r", "\x0b", "\xa0", "#", "|", "word ", "x y z ", "x y z\n", "\n\n"]
    rows = [(i, "".join(rng.choice(alphabet, rng.integers(0, 60)))) for i in range(300)] + [(300, ""), (301, None), (302, "\n"), (303, "x " * 40_000), (304, "one\ntwo\none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality_rules.judge(docs, docs.limit(5)).select("row.doc_id", "found.*").collect()}
    assert got == {i: slow_counts(t) for i, t in rows}


def test_texts_alike_are_judged_alike_whatever_stands_beside_them(spark, monkeypatch, texts):
    docs = spark.createDataFrame(texts[:80] + [(1000 + i, t) for i, t in texts[:80]], "doc_id long, text string")
    whole = {r[0]: r[1] for r in quality_rules.judge(docs, docs.where("doc_id < 40")).select("row.doc_id", "found").collect()}
    assert all(whole[i] == whole[1000 + i] for i, _ in texts[:80])
    monkeypatch.setattr(quality_rules, "CHUNK_BYTES", 1000)
    assert {r[0]: r[1] for r in quality_rules.judge(docs, docs.where("doc_id < 40")).select("row.doc_id", "found").collect()} == whole


def test_odd_rows(spark, odd):
    found = quality_rules.judge(odd, odd.select("doc_id"))
    assert found.select("row.*").columns == odd.columns and found.count() == odd.count()
    assert found.where("found.n_words = 0 and (found.kept or not found.base_failed or found.score <> 0)").count() == 0
    nobody = quality_rules.judge(odd, odd.limit(0).select("doc_id"))
    assert nobody.where("abs(found.score) > 1e-9").count() == 0
    assert quality_rules.judge(odd.limit(0), odd.select("doc_id")).count() == 0


def test_ids_beyond_what_may_be_broadcast(spark, monkeypatch, texts):
    docs = spark.createDataFrame(texts[:50], "doc_id long, text string")
    trusted = docs.where("doc_id % 2 = 0").unionByName(docs.limit(3))
    few = sorted(map(tuple, quality_rules.bucket_counts(docs, trusted).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, quality_rules.bucket_counts(docs, trusted).collect())) == few
