"""Toxicity and quality: held-out results, exact neighbours, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.llm import quality, queries, toxicity
from paperlake.llm.labels import rising

LARGER = "/root/testdata/sf0.01"


def judged(spark, query, label, folder):
    rows = query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    return np.array([r["predicted"] for r in out]), np.array([r[label] for r in out]), np.array([r["score"] for r in out])


def area(y, score):
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()).item()


def test_toxicity_on_held_out_rows(spark, folder):
    said, y, score = judged(spark, queries.op1_toxicity, "toxic", LARGER)
    assert said[y == 1].mean() > 0.5 and said[y == 0].mean() < 0.02 and area(y, score) > 0.75


def test_quality_on_held_out_rows(spark, folder):
    said, y, score = judged(spark, queries.op4_quality, "quality", LARGER)
    assert said[y == 1].mean() > 0.95 and said[y == 0].mean() < 0.2 and area(y, score) > 0.95


@pytest.mark.parametrize("query, by, out", [(queries.op1_toxicity, 4, 2), (queries.op4_quality, 5, 0)])
def test_rows_and_split(spark, folder, texts, query, by, out):
    got = {r["doc_id"]: r for r in query(spark, folder).collect()}
    assert set(got) == {i for i, _ in texts}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % by == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_labels_are_never_learned(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        turned = labels.withColumn(label, F.when(module.held_out(), 1 - F.col(label)).otherwise(F.col(label)))
        one, two = (module.train(docs, x) for x in (labels, turned))
        if module is quality:
            assert one == two
        else:
            assert one.terms == two.terms and one.names == two.names and one.labels.tolist() == two.labels.tolist()


def test_block_max_neighbours_are_those_of_a_full_comparison():
    rng = np.random.default_rng(2)
    many, terms = 500, 60
    dense = np.where(rng.random((many, terms)) < 0.08, rng.random((many, terms)), 0)
    dense[np.arange(many), rng.integers(0, terms, many)] += 0.5
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    dense[100:120] = dense[7]  # ties
    example, numbers = np.nonzero(dense)
    starts = np.concatenate(([0], np.cumsum(np.bincount(example, minlength=many))))
    index = toxicity.BlockMaxIndex(starts, numbers, dense[example, numbers], terms)
    for i in range(0, many, 9):
        own = np.flatnonzero(dense[i])
        found, scores = index.nearest(own, dense[i, own], 11, i)
        full = np.round(dense @ dense[i], 9)
        full[i] = 0
        want = np.lexsort((np.arange(many), -full))[:11]
        want = want[full[want] > 0]
        assert found.tolist() == want.tolist() and np.allclose(scores, full[want])


def test_isotonic_fit():
    levels, shares = rising(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]), np.ones(5))
    assert levels.tolist() == [1, 2, 4] and shares.tolist() == [0, 0.5, 1]


def test_lasso_drops_what_says_nothing():
    rng = np.random.default_rng(0)
    z = rng.integers(0, 2, (2000, 6)).astype(float)
    y = (rng.random(2000) < np.where(z[:, 0] == 1, 0.9, 0.1)).astype(float)
    _, weights = quality.lasso(z, y, np.ones(2000), penalty=0.02)
    assert weights[0] > 1 and np.all(weights[1:] == 0)


def test_compiled_rules_are_the_rules(spark, texts):
    model = quality.RuleModel(-0.3, [(quality.Rule(((0, True, 5.0), (3, False, 0.1))), 1.5), (quality.Rule(((9, False, 0.7),)), -2.0)])
    docs = spark.createDataFrame(texts[:50], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in quality.with_statistics(docs).select("row.doc_id", model.column(lambda s: F.col(f"found.{s}")).alias("s")).collect()}
    for i, text in texts[:50]:
        x = np.array([quality.statistics(text.encode())])
        margin = model.intercept + sum(w * r.holds(x)[0] for r, w in model.rules)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-margin)))


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_and_labels(spark, odd, module):
    some = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (None, 1, 1), (9, None, None), (2, 0, 1), (1, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    score = F.col("found.score") if module is toxicity else F.col("score")
    for labels in (some, some.limit(0)):
        got = module.score(odd, labels).select("row.*", score.alias("given"))
        assert got.count() == odd.count() and got.where("given is null or given < 0 or given > 1").count() == 0
        assert got.drop("given").columns == odd.columns
    assert module.score(odd.limit(0), some).count() == 0


def test_rare_insults_count_at_any_number_of_labels(spark):
    """A word in six of 400 toxic rows, among 6,000 labelled ones."""
    rows = [(0, f"plain words {i % 50}") for i in range(5_600)] + [(1, "plain words" + (" zorkish" if i < 6 else "")) for i in range(400)]
    sample = spark.createDataFrame(rows, "label int, text string")
    assert b"zorkish" in toxicity.associated_terms(sample, {0: 5_600, 1: 400})
