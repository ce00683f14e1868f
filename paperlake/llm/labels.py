"""Labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.frames import crc_rest


def labelled_sample(labels: DataFrame, label: str, by: int, held_out: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``2 * per_class`` rows (``doc_id``, ``label``) to learn from, and all rows per class.

    Rows whose crc32(doc_id) mod ``by`` is ``held_out``, and rows without id or label, take no part. A
    repeated id has its highest label. Those of least hash are taken, so the sample is as good as random
    and the same in every run.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_rest("doc_id", by) != held_out))
        .groupBy("doc_id")
        .agg((F.max(label) > 0).cast("int").alias("label"))
    )
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


def rising(values, hits, weights):
    """Isotonic fit (pool adjacent violators): thresholds and the share of hits from each on."""
    import numpy as np

    order = np.argsort(values, kind="stable")
    blocks: list[list[float]] = []  # first value, weighted hits, weight
    for v, h, w in zip(values[order].tolist(), hits[order].tolist(), weights[order].tolist(), strict=True):
        if blocks and v == blocks[-1][3]:
            blocks[-1][1] += h * w
            blocks[-1][2] += w
        else:
            blocks.append([v, h * w, w, v])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, h2, w2, last = blocks.pop()
            blocks[-1][1] += h2
            blocks[-1][2] += w2
            blocks[-1][3] = last
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
