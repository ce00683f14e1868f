"""Text quality by a sparse ensemble of rules over text statistics.

Small boosted trees over the statistics of labelled texts propose rules: every path from a root to
a node is a conjunction of comparisons. A lasso logistic regression keeps few of them. The
kept rules are compiled into one Spark column expression over the statistics, so scoring is
plain column arithmetic; only the statistics themselves come from a vectorised function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.frames import LOWER, crc_rest, map_texts
from paperlake.llm.labels import labelled_sample

BY, HELD_OUT = 5, 0
#: Labelled rows of each class that are learned from, at most.
PER_CLASS = 10_000
TREES, DEPTH, BINS, LEAST_ROWS, RATE = 40, 3, 32, 25, 0.3
PENALTY = 0.002
STEPS = 600
CUT = 0.3
STATISTICS = [
    "log_bytes", "log_words", "upper", "digit", "mark", "symbol", "space", "high", "word_length", "distinct_words",
    "most_frequent", "short_words", "marked_words", "lines", "distinct_lines", "words_per_line", "bar", "ended_lines",
    "capital_words", "distinct_bytes",
]
_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_SYMBOLS = np.array([b for b in _MARKS if chr(b) not in ".,;:!?'\"()-"])
_LETTER_END = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))


def statistics(text: bytes) -> list[float]:
    """STATISTICS of a UTF-8 text; all are finite, also for the empty text."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lowered = text.translate(LOWER).split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    many, some, rows = max(n, 1), max(len(words), 1), max(len(lines), 1)
    distinct: dict[bytes, int] = {}
    for w in lowered:
        distinct[w] = distinct.get(w, 0) + 1
    return [
        np.log1p(n),
        np.log1p(len(words)),
        counts[_UPPER].sum() / many,
        counts[_DIGIT].sum() / many,
        counts[_MARKS].sum() / many,
        counts[_SYMBOLS].sum() / many,
        (counts[32] + counts[9:14].sum()) / many,
        counts[128:].sum() / many,
        sum(map(len, words)) / some,
        len(distinct) / some,
        max(distinct.values(), default=0) / some,
        sum(len(w) < 4 for w in words) / some,
        sum(w[-1] not in _LETTER_END for w in words) / some,
        len(lines) / some,
        len(set(lines)) / rows,
        len(words) / rows,
        counts[124] / some,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / rows,
        sum(65 <= w[0] < 91 for w in words) / some,
        np.count_nonzero(counts) / 256,
    ]


@dataclass(frozen=True)
class Rule:
    """``tests``: (statistic, at least?, limit), all of which hold."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, limit in self.tests:
            out &= (x[:, k] >= limit) if above else (x[:, k] < limit)
        return out

    def column(self, of) -> Column:
        out = F.lit(True)
        for k, above, limit in self.tests:
            out = out & ((of(STATISTICS[k]) >= limit) if above else (of(STATISTICS[k]) < limit))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[k]} {'>=' if above else '<'} {limit:.6g}" for k, above, limit in self.tests)


def grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, bend: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """Paths of one tree on the gradient, and the step it takes for every row."""
    rules, step = [], np.zeros(len(x))

    def split(rows: np.ndarray, path: tuple) -> None:
        best = (1e-6, None)
        whole = slope[rows].sum() ** 2 / (bend[rows].sum() + 1)
        if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
            for k, limits in enumerate(edges):
                if not len(limits):
                    continue
                b = binned[rows, k]
                g, h, c = (np.cumsum(np.bincount(b, weights=w, minlength=len(limits) + 1))[:-1] for w in (slope[rows], bend[rows], np.ones(len(rows))))
                gain = g**2 / (h + 1) + (slope[rows].sum() - g) ** 2 / (bend[rows].sum() - h + 1) - whole
                gain[(c < LEAST_ROWS) | (len(rows) - c < LEAST_ROWS)] = 0
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], (k, j))
        if best[1] is None:
            step[rows] = RATE * slope[rows].sum() / (bend[rows].sum() + 1)
            return
        k, j = best[1]
        left = binned[rows, k] <= j
        for side, above in ((rows[left], False), (rows[~left], True)):
            inner = (*path, (k, above, float(edges[k][j])))
            rules.append(Rule(tidy(inner)))
            split(side, inner)

    split(np.arange(len(x)), ())
    return rules, step


def tidy(path: tuple) -> tuple:
    """One test per statistic and side: the tightest."""
    out: dict[tuple[int, bool], float] = {}
    for k, above, limit in path:
        held = out.get((k, above), limit)
        out[k, above] = max(held, limit) if above else min(held, limit)
    return tuple(sorted((k, a, v) for (k, a), v in out.items()))


def extracted_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[Rule]:
    """Different paths of boosted trees."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)
    prior = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    margin = np.full(len(y), np.log(prior / (1 - prior)))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rules, step = grow(x, binned, edges, weight * (y - p), weight * p * (1 - p))
        found.update(dict.fromkeys(rules))
        margin += step
        if not rules:
            break
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the intercept (accelerated proximal gradient)."""
    w = weight / weight.sum()
    a = np.concatenate([np.ones((len(z), 1)), z], axis=1)
    size = 0.25 * np.linalg.eigvalsh((a * w[:, None]).T @ a)[-1]
    prior = np.clip((w * y).sum(), 1e-3, 1 - 1e-3)
    b = np.zeros(a.shape[1])
    b[0] = np.log(prior / (1 - prior))
    ahead, t = b.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ ahead)))
        new = ahead - a.T @ (w * (p - y)) / size
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / size, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - b)
        b, t = new, t_new
    return float(b[0]), b[1:]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Rule, float]]

    def column(self, of) -> Column:
        """Score as a column; ``of`` gives the column of a statistic."""
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            margin = margin + F.when(rule.column(of), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``found`` (STATISTICS)."""

    def run(texts: list[bytes]) -> list[pa.Array]:
        values = np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))
        return [pa.array(values[:, k]) for k in range(len(STATISTICS))]

    return map_texts(docs, ", ".join(f"{s} double" for s in STATISTICS), run)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> RuleModel:
    """Rules from at most ``2 * per_class`` labelled documents; classes count by their shares of all labels."""
    ids, sizes = labelled_sample(labels, "quality", BY, HELD_OUT, per_class)
    rows = ids.collect()  # bounded by per_class
    if not rows:
        return RuleModel(0.0, [])
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(r["doc_id"], r["label"]) for r in rows], "doc_id long, label int"))
    sample = docs.select("doc_id", "text").join(wanted, "doc_id")
    found = with_statistics(sample).select("row.doc_id", "row.label", *[F.col(f"found.{s}") for s in STATISTICS]).toPandas().sort_values(["doc_id", *STATISTICS])
    x, y = found[STATISTICS].to_numpy(float), found["label"].to_numpy(float)
    if not len(y):
        return RuleModel(0.0, [])
    weight = np.array([sizes[int(v)] / max((y == v).sum(), 1) for v in y])
    if y.min() == y.max():
        share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        return RuleModel(float(np.log(share / (1 - share))), [])
    rules = extracted_rules(x, y, weight)
    if not rules:
        return RuleModel(float(np.log((weight * y).sum() / (weight * (1 - y)).sum())), [])
    intercept, weights = lasso(np.stack([r.holds(x) for r in rules], axis=1).astype(float), y, weight)
    return RuleModel(intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if w != 0])


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``row`` (all columns of ``docs``), ``found`` (statistics) and ``score`` (0 to 1) of every document.

    Null and empty texts have the statistics of the empty text and are scored by the same rules.
    Without labels every score is 0.5. Equal texts have equal scores.
    """
    model = train(docs, labels, per_class)
    return with_statistics(docs).select("row", "found", model.column(lambda s: F.col(f"found.{s}")).alias("score"))


def held_out(column: str = "doc_id"):
    return crc_rest(column, BY) == HELD_OUT
