"""Characters at the edges of cuts."""

from pyspark.sql import functions as F

import corpus_pipeline


def slow(text, spans):
    """The characters of a text that no cut touches."""
    out, at = "", 0
    for c in text:
        n = len(c.encode())
        if not any(a < at + n and at < b for a, b in spans):
            out += c
        at += n
    return out


def test_only_characters_that_a_cut_touches_go(spark):
    rows = []
    for text in ("a�é€😀�z" * 2, "😀😀�€€", "éé", "abc", "�", "€￿€x"):
        n = len(text.encode())
        rows += [(text, [(a, b)]) for a in range(n) for b in range(a + 1, n + 1)]
        rows += [(text, [(a, a + 1), (b, min(b + 5, n))]) for a in range(n - 3) for b in range(a + 2, n)] + [(text, [])]
    given = []
    for text, spans in rows:
        raw = text.encode()
        given.append((text, spans, bytes(x for i, x in enumerate(raw) if not any(a <= i < b for a, b in spans))))
    df = spark.createDataFrame(given, "text string, spans array<struct<start:long,stop:long>>, kept binary")
    got = df.select("text", "spans", corpus_pipeline.whole_characters(F.col("kept"), F.col("spans")).alias("new")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["new"] == slow(r["text"], [tuple(s) for s in r["spans"]]), r


def test_stage_keeps_replacement_characters_of_the_input(spark, folder):
    shared = "€" * 100
    rows = [(1, "own � text é" + shared + " end"), (2, "other₭" + shared + "₭�"), (3, "�")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeats_stage(spark, docs, folder).collect()}
    assert got == {1: "own � text é end", 2: "other₭�", 3: "�"}
