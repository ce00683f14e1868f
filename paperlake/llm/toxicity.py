"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words and their beginnings of four to six bytes, as inflected insults share a beginning.
Those that go with the label (chi-squared over the labelled sample, and far more frequent in one
class) are the vocabulary; document
frequencies are counted over all documents. Examples are kept in an inverted index cut into blocks
of ``BLOCK`` examples with the largest weight of every term in every block. A query visits blocks in
order of the best score they can hold and stops when that is no better than its k-th neighbour:
the neighbours are those of a full comparison. Neighbours vote by 1 / (distance + a constant), classes
weighted back to their shares; votes are calibrated (isotonic) on the examples, each judged
without itself. A text without a vocabulary term gets the share of label 1 among such examples.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.frames import ALNUM, chunks, crc_rest, map_texts, ragged, release, texts_of
from paperlake.llm.labels import labelled_sample, rising

BY, HELD_OUT = 4, 2
#: Labelled rows of each class that are learned from, at most.
PER_CLASS = 10_000
#: Terms of the vocabulary, at most; association and examples that a term needs at least.
TERMS = 4096
LEAST_CHI2 = 25.0
LEAST_DOCS = 4
#: A term must be so many times as frequent in one class as in the other.
LEAST_RATIO = 4.0
STARTS = (4, 5, 6)
NEIGHBOURS = 11
BLOCK = 64
NEAR = 0.05
CUT = 0.3
CHUNK_BYTES = 8 << 20
_MEMO = 1 << 19


def terms_of(word: bytes) -> list[bytes]:
    """The word, and its longer beginnings marked by a trailing star."""
    return [word, *(word[:n] + b"*" for n in STARTS if len(word) >= n)]


class Vocabulary:
    """Term counts of texts; every distinct word of a chunk is looked up once."""

    def __init__(self, terms: list[bytes]) -> None:
        self.numbers = {t: i for i, t in enumerate(terms)}
        self.begins = {t[: STARTS[0]] for t in terms if t.endswith(b"*")}

    def terms(self, word: bytes) -> list[int]:
        if word not in self.numbers and word[: STARTS[0]] not in self.begins:
            return []
        return [self.numbers[t] for t in terms_of(word) if t in self.numbers]

    def counts(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text: term numbers in order, and how often each occurs."""
        return [found for part in chunks(texts, CHUNK_BYTES) for found in self._counts(part)]

    def _counts(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        split = pc.ascii_split_whitespace(pa.array([t.translate(ALNUM) for t in texts], pa.binary()).cast(pa.string()))
        words = split.flatten().dictionary_encode()
        found = [self.terms(w) for w in words.dictionary.cast(pa.binary()).to_pylist()]
        sizes = np.array([len(f) for f in found], np.int64)
        flat = np.array([i for f in found for i in f], np.int64)
        at = words.indices.to_numpy()
        hit = np.flatnonzero(sizes[at]) if len(at) else np.empty(0, np.int64)
        at = at[hit]
        text = np.repeat(np.searchsorted(split.offsets.to_numpy(), hit, side="right") - 1, sizes[at])
        terms = flat[ragged((np.cumsum(sizes) - sizes)[at], sizes[at])]
        both, counts = np.unique(text * max(len(self.numbers), 1) + terms, return_counts=True)
        cuts = np.searchsorted(both, np.arange(len(texts) + 1) * max(len(self.numbers), 1))
        numbers = both % max(len(self.numbers), 1)
        return [(numbers[x:y], counts[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@dataclass
class Model:
    terms: list[bytes]
    idf: np.ndarray
    starts: np.ndarray  # of each example's terms
    numbers: np.ndarray
    weights: np.ndarray
    names: list[int]
    labels: np.ndarray
    votes: np.ndarray  # of each example's class
    levels: np.ndarray  # calibration: votes from here on ...
    shares: np.ndarray  # ... have this share of label 1
    none: float


def vector(numbers: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(counts)) * idf[numbers]
    return value / max(np.sqrt((value**2).sum()), 1e-12)


class BlockMaxIndex:
    """Examples by block, with the largest weight of each term in each block."""

    def __init__(self, starts: np.ndarray, numbers: np.ndarray, weights: np.ndarray, terms: int) -> None:
        self.starts, self.numbers, self.weights = starts, numbers, weights
        self.examples = len(starts) - 1
        self.blocks = -(-self.examples // BLOCK)
        example = np.repeat(np.arange(self.examples), np.diff(starts))
        self.most = np.zeros((terms, self.blocks))
        np.maximum.at(self.most, (numbers, example // BLOCK), weights)
        self.query = np.zeros(terms)

    def nearest(self, numbers: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the ``k`` largest positive cosines and these; equal ones by example number."""
        bound = weights @ self.most[numbers]
        self.query[numbers] = weights
        found, scores, worst = np.empty(0, np.int64), np.empty(0), 0.0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or bound[b] < worst - 1e-9:
                break
            first, last = b * BLOCK, min((b + 1) * BLOCK, self.examples)
            lo, hi = self.starts[first], self.starts[last]
            at = self.starts[first:last] - lo
            score = np.add.reduceat(self.query[self.numbers[lo:hi]] * self.weights[lo:hi], at)
            if first <= without < last:
                score[without - first] = 0
            hit = np.flatnonzero((score > 0) & (score >= worst - 1e-9))
            found = np.concatenate([found, hit + first])
            scores = np.concatenate([scores, score[hit]])
            if len(found) > k:
                keep = np.lexsort((found, -np.round(scores, 9)))[:k]
                found, scores = found[keep], scores[keep]
                worst = scores.min()
        self.query[numbers] = 0
        keep = np.lexsort((found, -np.round(scores, 9)))
        return found[keep], scores[keep]


class Judge:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.vocabulary = Vocabulary(model.terms)
        self.index = BlockMaxIndex(model.starts, model.numbers, model.weights, len(model.terms)) if len(model.names) else None
        self.memo: dict[bytes, tuple[float, list[int]]] = {}

    def vote(self, numbers: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[float | None, list[int]]:
        if not len(numbers) or self.index is None:
            return None, []
        found, scores = self.index.nearest(numbers, weights, NEIGHBOURS, without)
        if not len(found):
            return None, []
        say = self.model.votes[found] / (1 - np.minimum(scores, 1) + NEAR)
        return float((say * self.model.labels[found]).sum() / say.sum()), found.tolist()

    def scores(self, texts: list[bytes]) -> list[tuple[float, list[int]]]:
        """Calibrated score of each text and the doc_ids of the neighbours that it rests on."""
        return [self._score(numbers, counts) for numbers, counts in self.vocabulary.counts(texts)]

    def _score(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        key = numbers.tobytes() + counts.tobytes()
        if key not in self.memo:
            if len(self.memo) >= _MEMO >> 3:
                self.memo.clear()
            vote, found = self.vote(numbers, vector(numbers, counts, self.model.idf)) if len(numbers) else (None, [])
            self.memo[key] = (self.calibrated(vote), [self.model.names[i] for i in found])
        return self.memo[key]

    def calibrated(self, vote: float | None) -> float:
        if vote is None or not len(self.model.levels):
            return self.model.none
        return float(self.model.shares[max(0, int(np.searchsorted(self.model.levels, vote, side="right")) - 1)])


def associated_terms(sample: DataFrame, sizes: dict[int, int], most: int = TERMS) -> list[bytes]:
    """Terms of the labelled rows (``label``, ``text``) with the strongest chi-squared, strongest first."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            every = list(found[0].keys() | found[1].keys())
            counts = [pa.array([found[k][t] for t in every], pa.int64()) for k in (0, 1)]
            found[0].clear(), found[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), *counts], ["term", "n0", "n1"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                found[label].update({t for w in set(text.translate(ALNUM).split()) for t in terms_of(w)})
                if len(found[0]) + len(found[1]) > _MEMO:
                    yield rows()
        yield rows()
        release()

    n0, n1 = (F.lit(float(max(sizes.get(k, 0), 1))) for k in (0, 1))
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    c, d = n1 - a, n0 - b
    chi2 = (n0 + n1) * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * n0 * n1 + 1e-9)
    counted = sample.select("label", "text").mapInArrow(count, "term binary, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    one_sided = F.greatest(ratio, 1 / ratio) >= LEAST_RATIO
    best = counted.where((a + b >= LEAST_DOCS) & one_sided).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    return [bytes(r["term"]) for r in best.orderBy(F.desc("chi2"), "term").select("term").limit(most).collect()]


def document_frequencies(docs: DataFrame, terms: list[bytes]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total, rows = Vocabulary(terms), np.zeros(len(terms) + 1, np.int64), 0
        for batch in batches:
            for numbers, _ in vocabulary.counts(texts_of(batch.column(0))):
                total[numbers] += 1
                rows += 1
        total[-1] = rows
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["term", "n"])
        release()

    out = np.zeros(len(terms) + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Model of at most ``2 * per_class`` labelled documents; its size does not grow with the corpus."""
    ids, sizes = labelled_sample(labels, "toxic", BY, HELD_OUT, per_class)
    ids = ids.collect()  # bounded by per_class
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(r["doc_id"], r["label"]) for r in ids], "doc_id long, label int"))
    sample = docs.select("doc_id", "text").join(wanted, "doc_id")
    in_sample = Counter(r["label"] for r in ids)
    terms = associated_terms(sample, in_sample)
    df, rows = document_frequencies(docs, terms)
    idf = np.log((1 + rows) / (1 + df)) + 1

    def vectors(texts: list[bytes], built=[]) -> list[pa.Array]:  # noqa: B006  built once per task
        if not built:
            built.append(Vocabulary(terms))
        found = built[0].counts(texts)
        return [pa.array([list(map(int, f[k])) for f in found], pa.list_(pa.int64())) for k in (0, 1)]

    rows = map_texts(sample, "numbers array<bigint>, counts array<bigint>", vectors).select("row.doc_id", "row.label", "found.*").collect()
    rows = sorted({(r["doc_id"], tuple(r["numbers"]), tuple(r["counts"])): r["label"] for r in rows}.items())
    shares = {k: sizes.get(k, 0) / max(in_sample[k], 1) for k in (0, 1)}
    weight = lambda label: shares[label]
    empty = [label for (_, numbers, _), label in rows if not numbers]
    every = sum(map(weight, empty))
    prior = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    none = (sum(weight(x) for x in empty if x) + prior) / (every + 1) if empty else prior
    full = [(doc_id, np.array(n, np.int64), np.array(c), label) for (doc_id, n, c), label in rows if n]
    values = [vector(n, c, idf) for _, n, c, _ in full]
    order = sorted(range(len(full)), key=lambda i: (int(full[i][1][np.argmax(values[i])]), full[i][0]))  # like by like: tight blocks
    full, values = [full[i] for i in order], [values[i] for i in order]
    model = Model(
        terms,
        idf,
        np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int64),
        np.concatenate([f[1] for f in full]) if full else np.empty(0, np.int64),
        np.concatenate(values) if full else np.empty(0),
        [f[0] for f in full],
        np.array([f[3] for f in full], np.int64),
        np.array([weight(f[3]) for f in full]),
        np.empty(0),
        np.empty(0),
        none,
    )
    judge = Judge(model)
    said = [judge.vote(f[1], v, i)[0] for i, (f, v) in enumerate(zip(full, values, strict=True))]
    judged = [i for i, v in enumerate(said) if v is not None]
    if judged:
        model.levels, model.shares = rising(np.array([said[i] for i in judged]), model.labels[judged].astype(float), model.votes[judged])
    return model


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``row`` (all columns of ``docs``), ``found.score`` (0 to 1) and ``found.evidence`` (doc_ids of neighbours).

    Null and empty texts, like all without a term of the vocabulary, get the share of label 1 among
    such labelled rows. Without any labels every score is 0. Repeated rows get equal scores.
    """
    model = train(docs, labels, per_class)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by per_class and TERMS

    def run(texts: list[bytes], built=[]) -> list[pa.Array]:  # noqa: B006  built once per task
        if not built:
            built.append(Judge(Model(**shared.value)))
        found = built[0].scores(texts)
        return [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))]

    return map_texts(docs, "score double, evidence array<bigint>", run)


def held_out(column: str = "doc_id"):
    return crc_rest(column, BY) == HELD_OUT
