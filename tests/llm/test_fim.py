"""Fill-in-middle examples: pieces, their digests, and the texts that come back."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.llm import fim


def slow(doc_id, text):
    """Form, prefix, middle and output as strings."""
    text = text or ""
    found = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(found[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, text
    low, high = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = text[:low], text[low:high], text[high:]
    if h4 % 100 < 20:
        return "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows(texts):
    rng = np.random.default_rng(0)
    letters = list("aé日😀<>PSM\n\x00 ") + ["<P>", "<S", "M>", "é"]
    made = [(1000 + i, "".join(rng.choice(letters, rng.integers(0, 12)))) for i in range(400)]
    return texts + made + [(2000, None), (2001, ""), (None, "no id"), (2002, "x" * 300_000 + "é"), (2003, "same"), (2003, "same")]


def test_every_document_is_the_plain_string(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as found", "2 as row", "3 as form", "4 as n")
    found = fim.fill_in_middle(docs)
    assert found.select("row.*").columns == docs.columns
    got = found.select("row.doc_id", "row.text", "found", fim.render(F.col("row.text"), F.col("found.pieces"))).collect()
    assert len(got) == len(rows)
    forms = set()
    for doc_id, text, (n, form, prefix, middle, output_sha, restored_sha, pieces), shown in got:
        want = slow(doc_id, text)
        assert (form, prefix, middle, shown) == want and n == len(text or "")
        assert output_sha == hashlib.sha256(want[3].encode()).hexdigest()
        assert restored_sha == hashlib.sha256((text or "").encode()).hexdigest()
        output = shown.encode()
        assert fim.said(fim.restored(fim.parsed(output, form), form), output).decode() == (text or "")
        assert sum(p["length"] for p in pieces) == len(output)
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_cuts_split_descriptors():
    whole = [fim.Piece(fim.TEXT, 0, 10)]
    assert fim.split(fim.split(whole, 4), 7) == [fim.Piece(0, 0, 4), fim.Piece(0, 4, 3), fim.Piece(0, 7, 3)]
    assert fim.split(whole, 0) == [fim.Piece(0, 0, 0), fim.Piece(0, 0, 10)]
    three = fim.split(fim.split(whole, 0), 10)
    assert [p.length for p in three] == [0, 10, 0]
    for form in fim.ARRANGEMENTS:
        assert fim.restored(fim.arranged(three, form), form) == three
    with pytest.raises(ValueError):
        fim.split(whole, 11)


def test_outputs_that_are_none_are_refused():
    for output, form in ((b"text", "psm"), (b"<P>a<M>b", "psm"), (b"<P>a<S>b<M>c", "spm")):
        with pytest.raises(ValueError):
            fim.parsed(output, form)


def test_odd_rows(spark, odd):
    found = fim.fill_in_middle(odd)
    assert found.select("row.*").columns == odd.columns and found.count() == odd.count()
    assert found.where("found.form = 'plain' and (found.prefix_chars is not null or found.middle_chars is not null)").count() == 0
    assert found.where("coalesce(row.text, '') = '' and found.form <> 'plain'").count() == 0
    assert fim.fill_in_middle(odd.limit(0)).count() == 0
