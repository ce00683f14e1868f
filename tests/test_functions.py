import pytest
from pyspark.sql import functions as F

from paperlake.functions import citations, ids, lists, text


def values(spark, cases, expression, schema="x string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, {schema}")
    return [r.out for r in df.select("i", expression(F.col("x")).alias("out")).orderBy("i").collect()]


def test_strip_takes_all_white_space(spark):
    cases = [" a ", "\x1ca\x1f", "\xa0a\x85", "a \n", " \t ", "", None, "a  b", " a"]
    assert values(spark, cases, text.strip) == ["a", "a", "a", "a", "", "", None, "a  b", "a"]


def test_clean_text(spark):
    cases = ["  a\n b\t\tc ", "\x1ca\x85 b\xa0", "", None]
    assert values(spark, cases, text.clean_text) == ["a b c", "a b", "", ""]


def test_truncate(spark):
    cut = lambda n: lambda x: text.truncate(x, n)
    assert values(spark, ["hello", "", None], cut(10)) == ["hello", "", ""]
    assert values(spark, ["hello"], cut(5)) == ["hello"]
    assert values(spark, ["hello world", "abcd     efgh", "\U0001F600" * 9], cut(8)) == [
        "hello...", "abcd...", "\U0001F600" * 5 + "...",
    ]
    with pytest.raises(ValueError):
        text.truncate(F.col("x"), 3)


def test_quick_summary(spark):
    cases = ["", None, "...", "One", "A b. C d. E", "v 3.5 is x. Y", "a\nb. c", "x" * 600]
    none = "No abstract available."
    assert values(spark, cases, text.quick_summary) == [
        none, none, "...", "One.", "A b. C d.", "v 3. 5 is x.", "a b. c.", "x" * 500,
    ]


def test_tokens(spark):
    cases = ["The Deep-Learning of NLP, a 3.5 x 10", "", "éclair naïve", "are can"]
    assert values(spark, cases, text.tokens) == [["deep", "learning", "nlp", "10"], [], ["clair", "na", "ve"], []]


def test_dates(spark):
    assert values(spark, ["2024-03-15T12:30:00Z", "", None], text.date_part) == ["2024-03-15", "Unknown", "Unknown"]


def test_decode_lists(spark):
    cases = [
        '["Doe, Jr.", "Alice Smith"]', "Alice Smith, Bob Stone", "cs.AI,cs.CL, ,", "", None, "[]",
        '["a"] x', '["a"]["b"]', "['a', 'b']", "[a, b]", ' ["a\\"b", " c ", ""] ', "[1, null]", '["\\u00e9"]',
    ]
    assert values(spark, cases, lists.decode) == [
        ["Doe, Jr.", "Alice Smith"], ["Alice Smith", "Bob Stone"], ["cs.AI", "cs.CL"], [], [], [],
        ['["a"] x'], ['["a"]["b"]'], ["['a'", "'b']"], ["[a", "b]"], ['a"b', "c"], ["[1", "null]"], ["é"],
    ]


def test_encode_and_decode_agree(spark):
    items = [["Doe, Jr.", 'q"uote', "back\\slash", "é"], []]
    assert values(spark, items, lambda x: lists.decode(lists.encode(x)), "x array<string>") == items


def test_formats(spark):
    people = [["Alice"], ["Alice", "Bob", "Charlie", "Diana"], []]
    out = values(spark, people, lambda x: lists.format_authors(x, 2), "x array<string>")
    assert out == ["Alice", "Alice, Bob, et al.", "Unknown"]
    out = values(spark, [["a", "b", "c"], []], lambda x: lists.format_categories(x, 2), "x array<string>")
    assert out == ["a, b", "N/A"]
    out = values(spark, [["a", "b"], []], lists.primary_category, "x array<string>")
    assert out == ["a", "N/A"]


def test_ids(spark):
    cases = {
        "https://arxiv.org/abs/2401.12345v2": "2401.12345",
        "2401.12345": "2401.12345",
        "2401.1234": "2401.1234",
        "https://arxiv.org/abs/hep-th/9901001": "hep-th/9901001",
        "cond-mat/0001234v3": "cond-mat/0001234",
        "https://arxiv.org/abs/math.AG/0309136v2": "math.AG/0309136",
        "240112.12345": "0112.12345",
        "2401.123456": "2401.123456",
        "nothing": "nothing",
        "": "",
    }
    assert values(spark, list(cases), ids.extract_paper_id) == list(cases.values())


def test_ids_of_a_large_corpus(spark):
    cases = {
        "https://arxiv.org/abs/2405.100072v2": "2405.100072",
        "https://arxiv.org/abs/2407.1000074": "2407.1000074",
        "https://arxiv.org/abs/2401.123": "https://arxiv.org/abs/2401.123",
    }
    assert values(spark, list(cases), ids.extract_paper_id) == list(cases.values())


PAPER = {
    "paper_id": "2401.12345", "title": "Attention Is All You Need", "authors": ["Ashish Vaswani", "Noam Shazeer"],
    "published": "2017-06-12T17:57:34Z", "categories": ["cs.CL", "cs.AI"],
    "arxiv_url": "https://arxiv.org/abs/2401.12345", "doi": "10.1234/test",
}
SCHEMA = (
    "paper_id string, title string, authors array<string>, published string, "
    "categories array<string>, arxiv_url string, doi string"
)


def cited(spark, fmt, **changes):
    return spark.createDataFrame([{**PAPER, **changes}], SCHEMA).select(citations.cite(fmt)).first()[0]


def test_bibtex(spark):
    lines = cited(spark, "bibtex").split("\n")
    assert lines == [
        "@article{vaswani2017,",
        "  title     = {Attention Is All You Need},",
        "  author    = {Vaswani, Ashish and Shazeer, Noam},",
        "  year      = {2017},",
        "  eprint    = {2401.12345},",
        "  archivePrefix = {arXiv},",
        "  primaryClass  = {cs.CL},",
        "  url       = {https://arxiv.org/abs/2401.12345},",
        "  doi       = {10.1234/test},",
        "}",
    ]


def test_bibtex_of_bare_paper(spark):
    out = cited(spark, "bibtex", authors=[], published="", categories=[], doi="")
    assert out.startswith("@article{unknownnd,\n")
    assert "author    = {Unknown}" in out and "year      = {}" in out and "primaryClass  = {N/A}" in out
    assert "doi" not in out


@pytest.mark.parametrize(
    "title, expected",
    [
        ("A & B # C % D", r"A \& B \# C \% D"),
        ("E_x {F} G", r"E\_x \{F\} G"),
        ("A\\B", r"A\textbackslash{}B"),
        ("\\", r"\textbackslash{}"),
        ("a$1\\\\", r"a$1\textbackslash{}\textbackslash{}"),
    ],
)
def test_bibtex_escapes(spark, title, expected):
    assert f"title     = {{{expected}}}," in cited(spark, "bibtex", title=title)


def test_bibtex_key(spark):
    for name, key in {"Mary Ann O'Neil": "oneil", " Plato ": "plato", "李 明": "unknown", "A  B": "b"}.items():
        assert f"@article{{{key}2017," in cited(spark, "bibtex", authors=[name])


def test_plain_and_markdown(spark):
    assert cited(spark, "plain") == (
        "Ashish Vaswani, Noam Shazeer (2017). Attention Is All You Need. arXiv:2401.12345. doi:10.1234/test"
    )
    assert cited(spark, "plain", authors=[], published="", doi="") == "Unknown. Attention Is All You Need. arXiv:2401.12345."
    assert cited(spark, "markdown", doi=None) == (
        "Ashish Vaswani, Noam Shazeer (2017). **Attention Is All You Need**. "
        "[arXiv:2401.12345](https://arxiv.org/abs/2401.12345)"
    )


def test_unknown_format():
    with pytest.raises(ValueError):
        citations.cite("html")


def test_long_citation_goes_to_a_file(spark):
    from paperlake.operators.papers import citation_delivery

    df = spark.createDataFrame(
        [("p1", "plain", "x" * 3000), ("p2", "bibtex", "short")], "paper_id string, format string, citation string"
    )
    out = {r.paper_id: r for r in citation_delivery(df).collect()}
    assert out["p1"].delivery == "file" and out["p1"].payload is None and out["p1"].file_name == "p1.txt"
    assert out["p2"].payload == "**Bibtex citation for** `p2`\n```bibtex\nshort\n```"
    bare = citation_delivery(df, with_heading=False).where("paper_id = 'p2'").first()
    assert bare.payload == "```bibtex\nshort\n```"
    edge = spark.createDataFrame(
        [(str(n), "plain", "x" * n) for n in (1991, 1992)], "paper_id string, format string, citation string"
    )
    got = {r.paper_id: r.delivery for r in citation_delivery(edge, with_heading=False).collect()}
    assert got == {"1991": "inline", "1992": "file"}
