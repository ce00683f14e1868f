import pytest

from paperlake.llm import queries, token_counts


@pytest.fixture(scope="module")
def pieces():
    return token_counts.pieces_in(queries.tokenizer_path(queries.WORD_PIECES))


def greedy(word, known, longest):
    n = i = 0
    while i < len(word):
        i += next(k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in known)
        n += 1
    return n


def test_query_is_greedy_matching(spark, folder, texts, pieces):
    known, longest = set(pieces), max(map(len, pieces))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op8_token_counts(spark, folder).collect()}
    for i, text in texts:
        words = text.encode().split()
        assert got[i] == (len(words), sum(greedy(b" " + w, known, longest) for w in words))


def test_failure_links_on_nested_pieces():
    single = [bytes([b]) for b in range(256)]
    own = [*single, b"ab", b"abcde", b"cd", b"bcdef", b"aa", b"aaaaa"]
    automaton = token_counts.Automaton(own)
    for word in (b"", b"abcd", b"abcdx", b"abcdef", b"abcdabcde", b"aaaaaaaaa", b"aaaab", b"zabcdeabcd"):
        assert automaton.count(word) == greedy(word, set(own), 5), word
    with pytest.raises(ValueError):
        token_counts.Automaton([b"a"])


def test_odd_rows(spark, odd):
    got = token_counts.token_counts(odd, queries.tokenizer_path(queries.WORD_PIECES))
    assert got.select("row.*").columns == odd.columns and got.count() == odd.count()
    assert {r["n"] for r in got.where("row.doc_id in (4, 5, 8)").selectExpr("found.n_tokens as n").collect()} == {0}
    assert token_counts.token_counts(odd.limit(0), queries.tokenizer_path(queries.WORD_PIECES)).count() == 0
