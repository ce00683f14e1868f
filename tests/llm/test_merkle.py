"""Merkle manifests against a plain loop over every row."""

import hashlib

import pytest
from pyspark.sql import functions as F

from paperlake.llm import merkle
from paperlake.runtime import durable


def digest_of(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest_of(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def reduced(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest_of(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path_of(levels, i):
    steps = []
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        steps.append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
        i //= 3
    return steps


def fold(at, path):
    for place, others in path:
        at = digest_of(*others[:place], at, *others[place:])
    return at


def slow(rows):
    """doc_id, leaf, subroot, root, siblings' digest, root of the text without line ends, of (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: reduced([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names}
    top = reduced([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = path_of(trees[s], i) + path_of(top, k)
            found = leaf if row[4] is None else leaf_of((*row[:4], row[4].replace("\n", "")))
            out.append((row[0], leaf, trees[s][-1][0], top[-1][0], digest_of(*[x for _, o in path for x in o]), fold(found, path)))
    return sorted(out, key=str)


def fast(docs):
    found = merkle.verify_documents(docs, tampered=F.replace("text", F.lit("\n"), F.lit("")))
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")), "folded_root").collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("count", [1, 4, 244, 800])
def test_one_source_of_any_size(spark, count):
    rows = [(i * 7 % 1009, "s", "en", i, f"a\n{i}" if i % 3 else None) for i in range(count)]
    assert fast(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


def test_many_sources_nulls_ties_and_repeated_rows(spark):
    rows = [(i, f"s{i % 250}" if i % 5 else None, None, i, "é\n" * (i % 4)) for i in range(1300)]
    rows += [(None, None, None, None, None)] * 300 + [(7, "ß", "en", None, "")] * 7 + [(7, "ß", "en", None, "other")] * 2 + [(-3, "", "en", 1, "x" * 50_000)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as tree", "2 as rank", "3 as digest", "4 as extra", "5 as size")
    assert fast(docs) == slow(rows)
    assert fast(docs.limit(0)) == []


def test_a_source_larger_than_a_task_is_cut_by_range(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HOT_ROWS", 100)
    rows = [(i, "hot" if i % 3 else "cold", "en", 1, str(i)) for i in range(1000)]
    assert fast(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


def test_chosen_leaves_have_the_proofs_that_all_have(spark):
    rows = [(i, f"s{i % 2}", "en", 1, str(i)) for i in range(1600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    own = {c: F.col(c) for c in merkle.COLUMNS}
    table = merkle.manifest(durable(docs.select("source", "doc_id", merkle.leaf(own).alias("digest"), F.lit(0).alias("extra"))))
    everything = {r["doc_id"]: r for r in merkle.prove(table).collect()}
    wanted = table.leaves.where("doc_id in (3, 4, 1599)").select("tree", "rank")
    few = {r["doc_id"]: r for r in merkle.prove(table, wanted).collect()}
    assert len(everything) == 1600 and few == {i: everything[i] for i in (3, 4, 1599)}
    assert all(fold(r["leaf"], r["path"]) == table.root for r in everything.values())
