"""Byte-pair encoding over a table of distinct words.

1. Documents are dealt, where they are read, into shards of about ``SHARD_BYTES``. A shard lists its
   distinct words and a document becomes the positions of its words in that list. Words end at
   ASCII white space and where ASCII marks meet letters or digits, places that no piece of a
   supported tokenizer crosses, and A-Z is folded; a probe on the driver checks all three. Stretches with
   combining characters, or a letter that becomes one, are words as they stand: those join what is before them.
2. The lists of all shards meet by word: every distinct word of the corpus is encoded once, however
   many shards list it, and its ids go back to (shard, position).
3. Documents and ids meet by shard; positions become ids, and ids become pieces by a map-side
   join with the id-to-piece table, whose size is that of the vocabulary.

Texts are never shuffled: a document travels as variable-length integers, a word once per shard. One
exchange holds both, keyed by shard or by range of words, and is read by steps 2 and 3.
A shard is named after its word list, its partition and its place in it. Documents must be a
plan that yields the same rows in the same order when a task is repeated, as file scans do;
a shard whose word list is missing stops the job, it never gives wrong ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from paperlake.llm.frames import freed, partitions_for, ragged, release

#: A shard is held in memory, about 10 bytes of it for each byte of text.
SHARD_BYTES = 10 << 20
#: Letters and digits, and the ASCII marks (not the apostrophe) that never join them in a piece.
_INNER = r"0-9a-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
_MARK = r"\x00-\x08\x0e-\x1f!-&(-/:-@\[-`{-\x7f"
#: Combining characters, and the capital that is folded to a letter and one of them.
_JOINING = r"[\p{M}\x{130}]"
CHANGED = "a shard's word list is missing: the documents changed between two reads"


def words_in(chunks: pa.StringArray, special: tuple[str, ...]) -> pa.ListArray:
    """Words of every stretch without ASCII white space; one with a special token or a joining character stays whole."""
    cut = pc.ascii_lower(chunks)
    for one, other in ((_INNER, _MARK), (_MARK, _INNER)):
        cut = pc.replace_substring_regex(cut, f"([{one}])([{other}])", "\\1\n\\2")
    cut = pc.if_else(pc.match_substring_regex(chunks, _JOINING), chunks, cut)
    for token in special:
        cut = pc.if_else(pc.match_substring(chunks, token), chunks, cut)
    return pc.split_pattern(cut, "\n")


def tokenizer_of(definition: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    found = Tokenizer.from_str(definition)
    found.no_truncation()
    found.no_padding()
    return found


def probe(tokenizer: Tokenizer) -> None:
    """The places where words end must be ends of pieces, white space must leave no ids, A-Z be folded."""
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    for space in " \t\n\r\x0b\x0c":
        if ids(f"Ab1{space}{space}cd, e{space}") != ids("ab1") + ids("cd") + ids(",") + ids("e"):
            raise ValueError("this tokenizer keeps white space, case or marks; a table of words does not fit it")


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Unsigned integers as 7-bit groups, low ones first, and the bytes that each takes."""
    v = values.astype(np.uint64)
    size = 1 + sum((v >= (1 << (7 * k))).astype(np.int64) for k in range(1, 6))
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=1))):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[at[has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes(), size


def unpacked(data: np.ndarray) -> np.ndarray:
    """The integers that ``packed`` wrote into these bytes."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    size = ends - starts + 1
    out = np.zeros(len(ends), np.int64)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[has] |= (data[starts[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


class _Shard:
    """The word list of some texts, and the texts as positions in it."""

    def __init__(self, texts: pa.StringArray, special: tuple[str, ...], part: int, number: int) -> None:
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        chunks = split.flatten().dictionary_encode()
        parts = words_in(chunks.dictionary, special)
        words = parts.flatten().dictionary_encode()
        self.words = words.dictionary.cast(pa.binary()).to_pylist()
        inner = words.indices.to_numpy().astype(np.int64)
        first = parts.offsets.to_numpy().astype(np.int64)
        at = chunks.indices.to_numpy().astype(np.int64)
        lengths = (first[1:] - first[:-1])[at]
        self.positions = inner[ragged(first[:-1][at], lengths)]
        self.ends = np.concatenate(([0], np.cumsum(lengths)))[split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()]
        digest = xxhash.xxh3_64(b"%d %d " % (part, number))
        digest.update(b"\n".join(self.words))
        self.name = -1 - (digest.intdigest() >> 1)  # below all range numbers

    def word_rows(self, kind: pa.DataType, ranges: int) -> pa.RecordBatch:
        """One row per range of word hashes: positions as steps, and the words."""
        of = np.array([zlib.crc32(w) % ranges for w in self.words], np.int64)
        order = np.argsort(of, kind="stable")
        numbers, firsts = np.unique(of[order], return_index=True)
        groups = [order[a:b] for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(order)], strict=True)] if len(order) else []
        steps = [packed(np.diff(g, prepend=0))[0] for g in groups]
        texts = [b"\n".join([self.words[i] for i in g.tolist()]) for g in groups]
        return _rows(numbers, self.name, pa.nulls(len(groups), kind), steps, texts)

    def document_rows(self, ids: pa.Array) -> pa.RecordBatch:
        data, size = packed(self.positions)
        cuts = np.concatenate(([0], np.cumsum(size)))[self.ends].astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        return _rows(np.full(len(ids), self.name), self.name, ids, coded, pa.nulls(len(ids), pa.binary()))


def _rows(keys: np.ndarray, shard: int, ids: pa.Array, a, b) -> pa.RecordBatch:
    columns = [pa.array(keys.astype(np.int64)), pa.array(np.full(len(keys), shard, np.int64)), ids, pa.array(a, pa.binary()), pa.array(b, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["key", "shard", "doc_id", "a", "b"])


def _shards(docs: DataFrame, special: tuple[str, ...], shard_bytes: int, ranges: int) -> DataFrame:
    """Word lists (``key``: a range of words) and coded documents (``key``: their shard) of all shards."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, texts = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
            shard = _Shard(texts, special, part, number)
            yield shard.word_rows(ids.type, ranges)
            yield shard.document_rows(ids)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < len(ids):
                before = int(ends[start - 1]) if start else 0
                stop = min(len(ids), int(np.searchsorted(ends, before + shard_bytes - size)) + 1)
                held.append((ids.slice(start, stop - start), texts.slice(start, stop - start)))
                size += int(ends[stop - 1]) - before
                start = stop
                if size >= shard_bytes:
                    yield from flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield from flush()
            held.clear()
        release()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"key long, shard long, doc_id {id_type}, a binary, b binary"
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def encode_decode(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` of every row.

    ``path`` names a tokenizer file on the driver. Ids are those of encoding the whole text
    without added special tokens; ``decoded`` is those ids' pieces as the library joins them.
    Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated
    rows, null doc_ids stay, further columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    tokenizer = tokenizer_of(definition)
    probe(tokenizer)
    if tokenizer.decoder is not None:
        raise ValueError("pieces are joined by a space; this tokenizer has a decoder of its own")
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    # both are bounded by the vocabulary, not by the documents
    shared = spark.sparkContext.broadcast(definition)
    pieces = spark.sparkContext.broadcast([(tokenizer.id_to_token(i) or "").encode() for i in range(tokenizer.get_vocab_size())])

    built: list[Tokenizer] = []  # one in every task

    def encode(table: pa.Table) -> pa.Table:
        if table["key"][0].as_py() < 0:  # documents
            return pa.table({"shard": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("steps", "counts", "ids")}})
        lists = [w.split(b"\n") for w in table["b"].to_pylist()]
        if not built:
            built.append(tokenizer_of(shared.value))
        own = built[0]
        distinct = list(dict.fromkeys(w for words in lists for w in words))
        found: dict[bytes, list[int]] = {}
        for a in range(0, len(distinct), 1 << 14):
            part = distinct[a : a + (1 << 14)]
            found.update(zip(part, (e.ids for e in own.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)), strict=True))
        counts = [packed(np.array([len(found[w]) for w in words], np.int64))[0] for words in lists]
        ids = [packed(np.array([i for w in words for i in found[w]], np.int64))[0] for words in lists]
        return pa.table({"shard": table["shard"], "steps": table["a"], "counts": pa.array(counts, pa.binary()), "ids": pa.array(ids, pa.binary())})

    def assemble(listed: pa.Table, coded: pa.Table) -> pa.Table:
        if not coded.num_rows or coded["key"][0].as_py() >= 0:  # words
            return pa.table({"doc_id": coded["doc_id"].slice(0, 0), "ids": pa.array([], pa.binary()), "decoded": pa.array([], pa.string())})
        whole = lambda name: [unpacked(np.frombuffer(x, np.uint8)) for x in listed[name].to_pylist()] or [np.empty(0, np.int64)]
        at = np.concatenate([np.cumsum(x) for x in whole("steps")])
        counts, ids = np.concatenate(whole("counts")), np.concatenate(whole("ids"))
        n_ids, first = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if len(at) and at.max() >= len(at):
            raise ValueError(CHANGED)
        n_ids[at], first[at] = counts, np.cumsum(counts) - counts
        table = pieces.value
        said = [b" ".join([table[i] for i in ids[a : a + n].tolist()]) for a, n in zip(first.tolist(), n_ids.tolist(), strict=True)]
        ids = ids.astype("<u4")
        out_ids, out_text = [], []
        for data in coded["a"].to_pylist():
            words = unpacked(np.frombuffer(data, np.uint8))
            if len(words) and words.max() >= len(said):
                raise ValueError(CHANGED)
            words = words[n_ids[words] > 0]
            out_ids.append(ids[ragged(first[words], n_ids[words])].tobytes())
            out_text.append(b" ".join([said[i] for i in words.tolist()]))
        return pa.table({"doc_id": coded["doc_id"], "ids": pa.array(out_ids, pa.binary()), "decoded": pa.array(out_text, pa.binary()).cast(pa.string())})

    partitions = partitions_for(docs)
    dealt = _shards(docs, special, shard_bytes, partitions).repartition(partitions, "key")
    encoded = dealt.groupBy("key").applyInArrow(freed(encode), "shard long, steps binary, counts binary, ids binary")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # both read the one exchange: its rows are told apart inside the functions, so nothing is pushed below it
    return encoded.groupBy("shard").cogroup(dealt.groupBy("key")).applyInArrow(freed(assemble), f"doc_id {id_type}, ids binary, decoded string")
