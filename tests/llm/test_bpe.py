import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from paperlake.llm import bpe, queries

ODD = [
    "", None, "a\x1cb \x85 c\xa0d", "ΑΣ ΣΑΣ ς", "İstanbul ﬁ é  x", "<|endoftext|>hi <|startoftext|> A<|endoftext|>b", "don't I'LL we've '",
    "1234 ٣٤ ½", "日本語 テキスト", "😀😀 a😀b", "x" * 5000, " a　b​c", "\x00 \x01a", " ", "à́ b", "  lead\n\n\ttrail  ", "end.' 's,'s ...'d x.'ll O'Neil,'t a’s.",
    "a,b;c!!d\x01e\x1cf", "É,Ü!ß.ǅx-ɏ.ɐ.", "1,2.5%x", "e,́b", "é,b", "A<|END,x", "<|endoftext|>,a.B", "×÷.a×b",
    "J\u030c H\u0331ello T\u0308 W\u030a Y\u030a", "H\u0323\u0331e,x", "TEŞEKKÜRLERİ, EVİ. (SEVGİ) Evi. İ!İ,a", "A.H\u0331,b!", "\u030cJ,a",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def test_query_is_the_library(spark, folder, texts, tokenizer):
    def want(text):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        said = tokenizer.decode(ids, skip_special_tokens=False)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()

    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op5_bpe(spark, folder).collect()}
    assert got == {i: want(t) for i, t in texts}


@pytest.mark.parametrize("shard_bytes", [64, 1 << 20])
def test_odd_texts(spark, tokenizer, shard_bytes):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, queries.tokenizer_path(), shard_bytes).collect()}
    for i, text in enumerate(ODD):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist() == ids, repr(text)
        assert got[i]["decoded"] == tokenizer.decode(ids, skip_special_tokens=False), repr(text)


def test_no_difference_on_made_up_texts(tokenizer):
    """Words encoded one by one are the whole text's ids, on letters, marks, combining characters and dotted capitals."""
    rng = np.random.default_rng(7)
    letters = list("abJHTWYIZéÉßẞıİΣςдЖ日ﬁǅ٣½’“×\u0301\u030a\u030c\u0308\u0331\u0323\u0345\u0307\u0327\u200d\u0939\u093f가ᄀ") + list(",.!-'(%\"_1 \t\n") + ["'s", "I'LL", "J\u030c"]
    kinds = [letters, letters[:9] + list("İ\u0331\u030c,.!'"), list("HhTtJjWwYy\u0331\u0308\u030c\u030a\u0323.,'( ")]
    texts = ["".join(rng.choice(kinds[k % 3], rng.integers(1, 24))) for k in range(30_000)]
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    split = [bpe.words_in(pc.ascii_split_whitespace(pa.array([t])).flatten(), special).flatten().to_pylist() for t in texts]
    distinct = list({w for s in split for w in s})
    ids = dict(zip(distinct, (e.ids for e in tokenizer.encode_batch_fast(distinct, add_special_tokens=False)), strict=True))
    whole = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [t for t, s, e in zip(texts, split, whole, strict=True) if [i for w in s for i in ids[w]] != e.ids]
    assert wrong == []


def test_odd_rows(spark, odd):
    got = bpe.encode_decode(odd, queries.tokenizer_path()).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert bpe.encode_decode(odd.limit(0), queries.tokenizer_path()).count() == 0


def test_packed_round_trip():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**33])
    data, size = bpe.packed(values)
    assert len(data) == size.sum()
    assert bpe.unpacked(np.frombuffer(data, np.uint8)).tolist() == values.tolist()


def test_tokenizer_that_keeps_spaces_is_refused():
    with pytest.raises(ValueError):
        bpe.probe(Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")))
