"""Atom files and search."""

import pytest

from paperlake.operators import search
from paperlake.operators.similarity import term_bags
from paperlake.sources import atom
from paperlake.streaming import atom as stream

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom">\n<title>query</title>\n'
FULL = """<entry>
  <id>http://arxiv.org/abs/2401.12345v2</id>
  <updated>2024-02-01T00:00:00Z</updated><published>2024-01-01T00:00:00Z</published>
  <title>Attention  Is
     All You Need</title>
  <summary>  Two
 lines &amp; more. </summary>
  <author><name>Ashish Vaswani</name></author><author><name></name></author><author><name>Noam Shazeer</name></author>
  <arxiv:doi xmlns:arxiv="http://arxiv.org/schemas/atom">10.1234/test</arxiv:doi>
  <link href="http://arxiv.org/abs/2401.12345v2" rel="alternate" type="text/html"/>
  <link title="pdf" href="http://arxiv.org/pdf/2401.12345v2" rel="related"/>
  <link title="pdf" href="second" rel="related"/>
  <category term="cs.CL" scheme="s"/><category scheme="s"/><category term="cs.AI" scheme="s"/>
</entry>
"""
BARE = "<entry><id>http://arxiv.org/abs/hep-th/9901001</id><title>Bare</title><author><name>Solo</name></author></entry>\n"


def feed(folder, name, *entries):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEAD + "".join(entries) + "</feed>\n")


def test_feed_files(spark, tmp_path):
    feed(tmp_path / "feeds", "one.xml", FULL, BARE)
    full, bare = atom.read_feeds(spark, str(tmp_path / "feeds")).orderBy("paper_id").collect()
    assert full.asDict() == {
        "paper_id": "2401.12345", "title": "Attention Is All You Need", "authors": ["Ashish Vaswani", "Noam Shazeer"],
        "summary": "Two lines & more.", "published": "2024-01-01T00:00:00Z", "updated": "2024-02-01T00:00:00Z",
        "categories": ["cs.CL", "cs.AI"], "arxiv_url": "http://arxiv.org/abs/2401.12345v2",
        "pdf_url": "http://arxiv.org/pdf/2401.12345v2", "doi": "10.1234/test",
    }
    assert bare.asDict() == {
        "paper_id": "hep-th/9901001", "title": "Bare", "authors": ["Solo"], "summary": "", "published": "",
        "updated": "", "categories": [], "arxiv_url": "http://arxiv.org/abs/hep-th/9901001", "pdf_url": "", "doi": "",
    }


@pytest.mark.parametrize("broken", ["<entry><id>x</id><title>a & b</title></entry>", "<entry><id>x</id><title>a"])
def test_malformed_feed_is_an_error(spark, tmp_path, broken):
    folder = tmp_path / "bad"
    folder.mkdir()
    (folder / "bad.xml").write_text(HEAD + broken)
    with pytest.raises(Exception, match="(?i)malformed|XML"):
        atom.read_feeds(spark, str(folder)).collect()


def test_stream_keeps_the_first_of_each_id(spark, tmp_path):
    landing, path = tmp_path / "landing", str(tmp_path / "corpus")
    feed(landing, "one.xml", FULL)
    stream.start_ingest(spark, str(landing), path).awaitTermination()
    later = FULL.replace("Attention  Is", "Changed").replace("v2</id>", "v3</id>")
    feed(landing, "two.xml", later, BARE, BARE.replace("Bare", "Zare"))
    stream.start_ingest(spark, str(landing), path).awaitTermination()
    got = {r.paper_id: r.title for r in stream.read_corpus(spark, path).collect()}
    assert got == {"2401.12345": "Attention Is All You Need", "hep-th/9901001": "Bare"}


def dropped(query):
    return sum(
        state["customMetrics"].get("numDroppedDuplicateRows", 0)
        for progress in query.recentProgress
        for state in progress["stateOperators"]
    )


def test_repeats_are_dropped_before_the_look_up(spark, tmp_path):
    paths = {delay: str(tmp_path / f"corpus {delay}") for delay in (None, "1 day")}
    landing = tmp_path / "landing"
    later = FULL.replace("Attention  Is", "Changed").replace("v2</id>", "v3</id>")
    # years older in ``updated`` than all that came before: late by that clock, and still kept
    old = BARE.replace("9901001", "9001007").replace("<title>", "<updated>1990-01-01T00:00:00Z</updated><title>")
    arrivals = [
        [FULL, BARE, BARE],
        [FULL, BARE, later],
        [old, FULL, later],
        [],
    ]
    repeats = []
    for number, entries in enumerate(arrivals):  # each run restarts from the checkpoint
        if entries:
            feed(landing, f"{number}.xml", *entries)
        for delay, path in paths.items():
            query = stream.start_ingest(spark, str(landing), path, repeats_within=delay)
            query.awaitTermination()
            if delay:
                repeats.append(dropped(query))
    got = {delay: sorted(tuple(r) for r in stream.read_corpus(spark, path).drop("batch").collect()) for delay, path in paths.items()}
    assert got[None] == got["1 day"]
    assert [r[0] for r in got[None]] == ["2401.12345", "hep-th/9001007", "hep-th/9901001"]
    assert repeats == [1, 2, 2, 0]


def test_an_entry_past_the_delay_goes_to_the_exact_look_up(spark, tmp_path):
    landing, path = tmp_path / "landing", str(tmp_path / "corpus")
    feed(landing, "one.xml", FULL)
    stream.start_ingest(spark, str(landing), path, repeats_within="0 seconds").awaitTermination()
    for name in ("two.xml", "three.xml", "four.xml"):
        feed(landing, name, FULL, BARE)
        stream.start_ingest(spark, str(landing), path, repeats_within="0 seconds").awaitTermination()
    assert sorted(r.paper_id for r in stream.read_corpus(spark, path).collect()) == ["2401.12345", "hep-th/9901001"]


@pytest.fixture(scope="module")
def corpus(spark):
    data = [
        ("p1", "Deep graph models", "graph learning", ["cs.LG"], "2020-01-01", "2023-01-01"),
        ("p2", "Graph theory", "", ["math.CO", "cs.DM"], "2021-01-01", "2022-01-01"),
        ("p3", "Galaxy survey", "deep survey of graph data", ["astro-ph"], "2019-01-01", "2021-01-01"),
        ("p4", "", "untitled deep", ["cs.LG"], "2018-01-01", "2024-01-01"),
    ]
    return spark.createDataFrame(
        data, "paper_id string, title string, summary string, categories array<string>, published string, updated string"
    )


def run_search(spark, corpus, requests, hot_rows=1_000_000):
    asked = spark.createDataFrame(
        requests, "request_id string, query string, category string, sort_by string, sort_order string, max_results int"
    )
    found = search.search(asked, corpus, term_bags(corpus, ["paper_id"]), hot_rows=hot_rows)
    out = {}
    for r in found.orderBy("request_id", "rank").collect():
        out.setdefault(r.request_id, []).append(r.paper_id)
    return out


@pytest.mark.parametrize("hot_rows", [1_000_000, 1])
def test_search(spark, corpus, hot_rows):
    got = run_search(
        spark, corpus,
        [
            ("all terms", "Deep GRAPH", None, None, None, None),
            ("category", "graph", "cs.DM", "", "", 5),
            ("newest", "graph", "", "submittedDate", "descending", 2),
            ("oldest", "graph", "", "submittedDate", "ascending", 10),
            ("updated", "deep", None, "lastUpdatedDate", "descending", 99),
            ("odd options", "graph theory", None, "popularity", "sideways", 5),
            ("only category", "", "cs.LG", "submittedDate", "ascending", 5),
            ("everything", "", "", "relevance", "descending", 3),
            ("only stopwords", "the of", None, "lastUpdatedDate", "descending", 2),
            ("nothing", "deep unheard", None, None, None, 5),
        ],
        hot_rows,
    )
    assert sorted(got.pop("all terms")) == ["p1", "p3"]
    assert got == {
        "category": ["p2"], "newest": ["p2", "p1"], "oldest": ["p3", "p1", "p2"], "updated": ["p4", "p1", "p3"],
        "odd options": ["p2"], "only category": ["p4", "p1"], "everything": ["p1", "p2", "p3"],
        "only stopwords": ["p4", "p1"],
    }


def test_lookup(spark, corpus, rows):
    asked = spark.createDataFrame([(" p1 ",), ("p4",), ("zz",), ("  ",), ("p1",)], "paper_id string")
    assert rows(search.lookup_by_id(asked, corpus), "paper_id", "found", "title") == [
        ("p1", True, "Deep graph models"), ("p4", False, None), ("zz", False, None),
    ]


def test_budget_keeps_a_prefix(spark):
    long = "w" * 400
    papers = spark.createDataFrame(
        [(f"p{i:02d}", long, ["A", "B", "C"], long, "2020-01-01", ["c"], "u" * 100, "v" * 200) for i in range(25)],
        "paper_id string, title string, authors array<string>, summary string, published string, "
        "categories array<string>, arxiv_url string, pdf_url string",
    )
    results = spark.createDataFrame([("r", "query", i + 1, f"p{i:02d}") for i in range(25)], "request_id string, query string, rank int, paper_id string")
    got = search.budgeted_listing(results, papers).orderBy("rank").collect()
    one = len(got[0].line_name) + len(got[0].line_value)
    assert got[0].line_name == "`1` " + "w" * 197 + "..."
    assert 0 < len(got) < 25 and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert got[-1].used <= 5900 < got[-1].used + one and got[0].shown == len(got) and got[0].total == 25
