"""The pipeline against its stages in plain Python on what each stage was given."""

import numpy as np
import pyarrow as pa
import pytest
from test_decontaminate import slow as slow_contamination
from test_simhash import classes, slow_print
from test_suffix_dedup import slow as slow_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from paperlake.llm import queries, toxicity
from paperlake.runtime import durable


def test_stages_one_by_one(spark, folder, duck):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, folder))
        seen.append(docs)
    assert all(d.columns == columns for d in seen[:-1])
    rows = [{r["doc_id"]: r for r in d.collect()} for d in seen]

    scores = {r["doc_id"]: r["score"] for r in queries.op1_toxicity(spark, folder).collect()}
    assert rows[1] == {i: r for i, r in rows[0].items() if scores[i] < toxicity.CUT}

    label = classes({i: slow_print(r["text"]) for i, r in rows[1].items()})
    assert rows[2] == {i: r for i, r in rows[1].items() if label[i] == i}

    repeats = {r[0]: r for r in slow_repeats([(i, r["text"]) for i, r in rows[2].items()])}
    assert set(rows[3]) == {i for i, r in repeats.items() if r[1] == 0 or r[2] < r[1]}
    for i, r in rows[3].items():
        assert r["n_chars"] == len(r["text"])
        if repeats[i][2] == 0:
            assert r["text"] == rows[2][i]["text"]
        else:
            assert 0 <= (repeats[i][1] - repeats[i][2]) - len(r["text"].encode()) <= 6 * repeats[i][3]

    items = duck.sql("select item_id, text from benchmark").fetchall()
    dirty = {r[0] for r in slow_contamination([(i, r["text"]) for i, r in rows[3].items()], items) if r[5]}
    assert rows[4] == {i: r for i, r in rows[3].items() if i not in dirty}

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    for i, r in rows[5].items():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == tokenizer.encode(rows[4][i]["text"], add_special_tokens=False).ids
    assert set(rows[5]) == set(rows[4])


def test_odd_rows_pass_every_stage(spark, folder, odd):
    for docs in (odd.selectExpr("doc_id", "text", "lang", "lang as source", "1L as n_chars", "found", "row", "key"), odd.limit(0)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = durable(stage(spark, docs, folder))
            assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_gives_python_small_batches(spark, folder, name, stage):
    for key in corpus_pipeline.SETTINGS:
        spark.conf.unset(key)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    docs = spark.range(0, 800, 1, 1).selectExpr("id as doc_id", "repeat(cast(id as string), 5000) as text", "'en' as lang", "'a' as source", "1L as n_chars")
    stage(spark, docs.limit(0), folder)
    found = [r["n"] for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 8 << 20
    assert max(found) < 3 << 20
