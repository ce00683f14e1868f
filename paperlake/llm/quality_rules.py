"""Quality rules, and a hashed n-gram likelihood ratio for the texts that pass them.

The rules are counts of a text: words, their characters, symbols, lines that repeat an earlier one, and words inside
repeated 3-word windows. A text of few words, or of mostly repeated ones, fails.

The ratio compares two multinomials over hashed words and word pairs (A-Z lower-cased): that of trusted
documents (labelled as of quality) and that of the raw corpus (all documents). A text's score is the mean over its n-grams of
``log p_trusted - log p_raw``; it is kept from ``CUT`` on, whatever its length, and the same text is always judged alike.

Both are summed over every document in one pass: tasks add up their counts, a shuffle adds those of all tasks, and
what reaches the driver is one number per bucket. Counts of trusted documents are pulled towards the raw corpus by
``PRIOR`` pseudo-counts a bucket, so n-grams that are too rare to tell anything weigh about nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.frames import LOWER, chunks, map_texts, texts_of
from paperlake.operators.skew import BROADCAST_BYTES

#: Buckets of n-grams: the length of both multinomials, and of what is broadcast.
BUCKETS = 1 << 16
PRIOR = 20.0
CUT = -0.1
LEAST_WORDS = 50
#: Share of words in repeated windows, in hundredths, above which a text fails.
MOST_REPEATED = 50
WINDOW = 3
#: Bytes of text that are looked at together.
CHUNK_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)


class Words:
    """Words of some texts as numbers, equal ones alike."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # every text ends with a line
        self.ends = np.cumsum([len(t) + 1 for t in texts])
        self.starts = self.ends - [len(t) + 1 for t in texts]
        space = _SPACE[self.data]
        self.letters = self.data[~space]
        edge = np.diff(space.view(np.int8), prepend=1)
        self.at = np.flatnonzero(edge == -1)
        offsets = np.concatenate(([0], np.cumsum(np.flatnonzero(edge[1:] == 1) + 1 - self.at)))
        coded = _binary(self.letters, offsets).dictionary_encode()
        self.ids, self.distinct = coded.indices.to_numpy(), coded.dictionary
        first = np.searchsorted(self.at, self.starts)
        self.count = np.diff(np.append(first, len(self.at)))
        self.first = first
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.count)
        self.letter_ends = offsets[np.append(first, len(self.at))]

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Number of flagged bytes of every text."""
        return np.add.reduceat(flags, self.starts, dtype=np.int64)

    def characters(self) -> np.ndarray:
        """Code points of all words of every text."""
        leads = np.append((self.letters & 0xC0) != 0x80, False)
        if len(leads) == 1:
            return np.zeros(len(self.starts), np.int64)
        found = np.add.reduceat(leads, np.minimum(self.letter_ends[:-1], len(leads) - 1), dtype=np.int64)
        return np.where(self.count > 0, found, 0)

    def repeated_lines(self) -> np.ndarray:
        """Lines of every text that have a word and equal an earlier line of it."""
        stops = np.flatnonzero(self.data == 10) + 1
        begins = np.concatenate(([0], stops[:-1]))
        said = np.searchsorted(self.at, begins) < np.searchsorted(self.at, stops)
        lines = _binary(self.data, np.concatenate(([0], stops))).dictionary_encode().indices.to_numpy()[said].astype(np.int64)
        doc = np.searchsorted(self.ends, begins[said], side="right")
        distinct = np.unique(doc * (int(lines.max(initial=0)) + 1) + lines)
        docs = len(self.starts)
        return np.bincount(doc, minlength=docs) - np.bincount(distinct // (int(lines.max(initial=0)) + 1), minlength=docs)

    def repeated_words(self) -> np.ndarray:
        """Words of every text that lie in a window of ``WINDOW`` words found twice or more in it."""
        docs, n = len(self.starts), len(self.ids) - WINDOW + 1
        if n < 1:
            return np.zeros(docs, np.int64)
        inside = np.flatnonzero(self.doc[:n] == self.doc[WINDOW - 1 :])
        key = self.doc[inside].astype(np.uint64)
        for k in range(WINDOW):
            key = (key ^ (key >> _SHIFT)) * _PAIR + self.ids[inside + k].astype(np.uint64)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        close = inside[np.sort(order[np.concatenate((same, [False])) | np.concatenate(([False], same))])]
        covered = np.zeros(len(self.ids), bool)
        if len(close):  # equal keys, now compared word by word
            rows = np.stack([self.doc[close], *[self.ids[close + k] for k in range(WINDOW)]], axis=1)
            _, which, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            for k in range(WINDOW):
                covered[close[times[which.reshape(-1)] > 1] + k] = True
        return np.bincount(self.doc[covered], minlength=docs)

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of every word, and of every pair of neighbours (-1 behind a text's last word)."""
        prints = np.array([xxhash.xxh64_intdigest(w.translate(LOWER)) for w in self.distinct.to_pylist()], np.uint64)[self.ids]
        mask = np.uint64(BUCKETS - 1)
        pairs = np.full(len(prints), -1, np.int64)
        mixed = prints[:-1] * _PAIR + prints[1:]
        together = self.doc[:-1] == self.doc[1:]
        pairs[:-1][together] = ((mixed ^ (mixed >> _SHIFT)) & mask)[together]
        return (prints & mask).astype(np.int64), pairs


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def bucket_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``bucket``, ``raw`` and ``trusted``: n-grams of all documents, and of those whose doc_id is in ``trusted``."""
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    if ids.count() * 16 <= BROADCAST_BYTES:  # beyond it the documents move to their ids
        ids = F.broadcast(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            marks, at = batch.column(0).fill_null(False).to_numpy(zero_copy_only=False), 0
            for texts in chunks(texts_of(batch.column(1)), CHUNK_BYTES):
                own = Words(texts)
                chosen = marks[at : at + len(texts)][own.doc]
                at += len(texts)
                for found in own.buckets():
                    sums[0] += np.bincount(found[found >= 0], minlength=BUCKETS)
                    sums[1] += np.bincount(found[(found >= 0) & chosen], minlength=BUCKETS)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[0][used]), pa.array(sums[1][used])], ["bucket", "raw", "trusted"])

    marked = docs.select("doc_id", "text").join(ids, "doc_id", "left").select("trusted", "text")
    counts = marked.mapInArrow(run, "bucket int, raw long, trusted long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def log_ratios(raw: np.ndarray, trusted: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """``log p_trusted - log p_raw`` of every bucket; 0 where neither says anything."""
    p_raw = (raw + 1.0) / (raw.sum() + len(raw))
    p_trusted = p_raw * (trusted + prior) / (trusted.sum() * p_raw + prior)
    return np.log(p_trusted / p_trusted.sum()) - np.log(p_raw)


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Log ratios of all buckets, from every document; at most ``BUCKETS`` rows reach the driver."""
    counts = np.zeros((2, BUCKETS))
    for row in bucket_counts(docs, trusted).collect():
        counts[:, row["bucket"]] = row["raw"], row["trusted"]
    return log_ratios(*counts)


def judge(docs: DataFrame, trusted: DataFrame, cut: float = CUT) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``found``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score,
    base_failed, kept.

    Null texts have no words, as empty ones. A text without words has score 0. Repeated rows are judged alike, a repeated or
    null id of ``trusted`` counts once or not at all, without trusted documents every score is 0; an empty table gives no rows.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(fit(docs, trusted))

    def function(texts: list[bytes]) -> list[pa.Array]:
        own, table = Words(texts), ratios.value
        words, pairs = own.buckets()
        gains = table[words] + np.where(pairs >= 0, table[pairs], 0.0)
        grams = np.maximum(2 * own.count - 1, 1)
        some = own.count > 0
        score = np.zeros(len(texts))
        if some.any():
            score[some] = np.add.reduceat(gains, own.first[some]) / grams[some]
        repeated = own.repeated_words()
        failed = (own.count < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * own.count)
        longs = [own.count, own.characters(), own.sums(_SYMBOL[own.data]), own.repeated_lines(), repeated]
        return [*[x.astype(np.int64) for x in longs], score, failed, ~failed & (score >= cut)]

    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, base_failed boolean, kept boolean"
    return map_texts(docs, fields, function, chunk_bytes=CHUNK_BYTES)


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled as of quality."""
    return labels.where("quality > 0").select("doc_id")
