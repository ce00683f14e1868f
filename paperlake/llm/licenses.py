"""Licence scans: statements in files by TF-IDF cosine to templates, then inheritance along paths.

Document frequencies of the templates' terms are counted over all documents. A line's vector has its
terms' weights; terms of no template weigh as never seen. From the weights follows which terms
a line must share with some template to reach the threshold at all; only documents with one of
these are looked at line by line. A file without a statement takes that of the nearest directory
above it that has a licence file. Everything is built from DataFrame functions.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statements by licence. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
THRESHOLD = 0.75
NO_TERM = "[^a-z0-9]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_in(text: str) -> list[str]:
    return [t for t in re.split(NO_TERM, text.lower()) if t]


def terms_of(text: Column) -> Column:
    """Terms of a text column: runs of ASCII letters and digits, A-Z folded."""
    return F.filter(F.split(F.translate(text, UPPER, LOWERED), NO_TERM), lambda t: t != "")


class Weights:
    """Inverse document frequencies of template terms and the templates' unit vectors."""

    def __init__(self, counts: dict[str, int], documents: int, templates: dict[str, str], threshold: float) -> None:
        self.idf = {t: math.log((1 + documents) / (1 + n)) + 1 for t, n in counts.items()}
        self.unseen = math.log(1 + documents) + 1
        self.vectors: dict[str, dict[str, float]] = {}
        for name, text in templates.items():
            weights = {t: n * self.idf[t] for t, n in Counter(terms_in(text)).items()}
            size = math.sqrt(sum(w * w for w in weights.values()))
            self.vectors[name] = {t: w / size for t, w in weights.items()}
        # the commonest terms, as long as no template reaches the threshold by them alone
        common: set[str] = set()
        for term in sorted(self.idf, key=lambda t: (self.idf[t], t)):
            more = common | {term}
            if any(math.sqrt(sum(w * w for t, w in v.items() if t in more)) >= threshold for v in self.vectors.values()):
                break
            common = more
        self.needed = sorted(set(self.idf) - common)

    def best(self, terms: Column) -> Column:
        """Best template of a line (its terms): score, negative place in the templates, name."""
        listed = sorted(self.idf)
        numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda n, v: n + v)
        count = lambda t: F.size(F.filter(terms, lambda x: x == t))
        counts = F.transform(F.array(*map(F.lit, listed)), count)
        others = F.array_distinct(F.filter(terms, lambda t: ~F.array_contains(F.array(*map(F.lit, listed)), t)))
        squares = total(F.transform(others, lambda t: (count(t) * count(t) * F.lit(self.unseen**2)).cast("double")))
        size = F.sqrt(squares + total(F.zip_with(counts, numbers(self.idf[t] for t in listed), lambda n, w: n * w * n * w)))

        def from_counts(known: Column) -> Column:
            scored = []
            for k, (name, v) in enumerate(self.vectors.items()):
                dot = total(F.zip_with(known["counts"], numbers(self.idf[t] * v.get(t, 0.0) for t in listed), lambda n, w: n * w))
                score = F.when(known["size"] > 0, F.round(dot / known["size"], 6)).otherwise(F.lit(0.0))
                scored.append(F.struct(score.alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("license")))
            return F.greatest(*scored)

        return F.element_at(F.transform(F.array(F.struct(counts.alias("counts"), size.alias("size"))), from_counts), 1)


def statements(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (all columns of ``docs``) and its best statement: ``license``, ``score``, ``line`` (from 1).

    Equal scores go to the earlier line, then to the licence first in order. Without a line
    at the threshold, and for null texts, all three are null.
    """
    templates = templates or TEMPLATES
    every = sorted({t for text in templates.values() for t in terms_in(text)})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    listed = F.array(*map(F.lit, every))
    present = F.explode(F.array_intersect(listed, terms_of(text)))
    counts = {t: 0 for t in every} | {r["term"]: r["n"] for r in rows.select(present.alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    own = Weights(counts, rows.count(), templates, threshold)

    looked = F.arrays_overlap(terms_of(text), F.array(*map(F.lit, own.needed)))
    lines = F.transform(F.split(text, "\n"), lambda line, k: F.struct((k + 1).alias("line"), terms_of(line).alias("terms")))
    lines = F.filter(lines, lambda x: F.arrays_overlap(x["terms"], F.array(*map(F.lit, own.needed))))

    def of_line(line: Column) -> Column:
        best = own.best(line["terms"])
        return F.struct(best["score"].alias("score"), (-line["line"]).alias("before"), best["order"].alias("order"), best["license"].alias("license"))

    found = F.array_max(F.transform(lines, of_line))
    seen = rows.withColumn("best", F.when(looked, found))
    hit = F.col("best.score") >= threshold
    return seen.select("row", F.when(hit, F.col("best.license")).alias("license"), F.when(hit, F.col("best.score")).alias("score"), F.when(hit, -F.col("best.before")).alias("line"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited(files: DataFrame) -> DataFrame:
    """Licence of every file (``path``, ``license``, ``score`` and any others): adds ``licensed_as``, ``how``, ``from_directory``.

    ``how`` is ``header`` for an own statement, ``inherited`` for that of the licence files (LICENSE, LICENCE
    or COPYING, with any ending) of the nearest directory above, the file's own included, else ``none``. Of
    several licence files in a directory the best score counts, then the later licence name. Null
    paths inherit nothing. Different directories are resolved once each, whatever they hold.
    """
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(r"(?i)^(licen[sc]e|copying)(\..*)?$")
    given = files.where(named & F.col("license").isNotNull()).groupBy(directory(F.col("path")).alias("above")).agg(F.max(F.struct("score", "license")).alias("given"))
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))
    resolved = (
        files.where("path is not null")
        .select(directory(F.col("path")).alias("directory"))
        .distinct()
        .select("directory", F.posexplode(above).alias("up", "above"))
        .join(given, "above")
        .groupBy("directory")
        .agg(F.min_by(F.struct("above", F.col("given.license").alias("license")), "up").alias("nearest"))
    )
    joined = files.withColumn("directory", directory(F.col("path"))).join(resolved, "directory", "left")
    own = F.col("license").isNotNull()
    return joined.select(
        *files.columns,
        F.coalesce("license", "nearest.license").alias("licensed_as"),
        F.when(own, "header").when(F.col("nearest").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(~own, F.col("nearest.above")).alias("from_directory"),
    )
