"""Helpers of grouped functions."""

import os

import pyarrow as pa
import pytest

from paperlake.llm import bpe, frames, suffix_dedup


def resident():
    with open("/proc/self/statm") as file:
        return int(file.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="no /proc")
def test_memory_of_the_last_group_goes_back():
    """Blocks below malloc's mmap threshold stay with the process unless they are handed back."""

    pinned = []

    def wasteful(table):
        held = [b"%d" % i * 10_000 for i in range(4_000)]
        pinned.append(b"x" * 40_000)  # lies above, so malloc does not shrink by itself
        del held
        return table

    table = pa.table({"a": [1]})
    before = resident()
    assert frames.freed(wasteful)(table) is table
    assert resident() - before < 50 << 20


def test_group_and_pair_keep_their_arguments():
    one, two = pa.table({"a": [1]}), pa.table({"b": [2]})
    assert frames.freed(lambda t: t)(one) is one
    assert frames.freed(lambda t, o: o)(one, two) is two


@pytest.mark.parametrize("run", [lambda docs: suffix_dedup.remove_repeats(docs), lambda docs: bpe.encode_decode(docs, __import__("paperlake.llm.queries").llm.queries.tokenizer_path())])
def test_grouped_functions_release_after_the_last_group(spark, monkeypatch, run):
    wrapped = []
    monkeypatch.setattr(suffix_dedup if "remove_repeats" in run.__code__.co_names else bpe, "freed", lambda f: wrapped.append(f.__name__) or frames.freed(f), raising=True)
    docs = spark.createDataFrame([(1, "one two " * 60), (2, "one two " * 60), (3, "three")], "doc_id long, text string")
    assert len(run(docs).collect()) == 3
    assert sorted(set(wrapped)) in (["cut", "keys", "merge", "strings"], ["assemble", "encode"])
