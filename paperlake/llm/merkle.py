"""Merkle manifest of a table, proofs by descent through content-addressed records.

Every row is a leaf: the digest of its columns. The leaves of a source, in the order of their ids,
are reduced by threes to the source's subroot, and the subroots, in the order of the sources, to the root.

* Build: a pass gathers ``SPAN`` consecutive nodes of a tree, reduces them ``STEPS`` levels and stores
  what it made as digest-to-children records. The records of a block are kept together under
  the block's own digest, so equal subtrees are stored once. Each pass leaves 1/243 of the nodes.
* Proof: requests descend from the root. A block's place among its siblings is the requests' rank in
  base ``FAN``; at every record the digit selects a child, and the others are collected. Requests that
  share a prefix share the descent: a pass joins as many rows as there are distinct prefixes, and
  the requests themselves take part in the last one only. Reversed, the segments of the path lead from the leaf to the root.

Texts are read once, where they are, and only digests are shuffled. Ranks inside a source come from a range
partitioning, so a source may hold any share of the rows; no task ever holds more than a block of ``SPAN`` nodes.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.llm.frames import partitions_for
from paperlake.operators.skew import HOT_ROWS, rank_in_group
from paperlake.runtime import durable

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
STEPS = 5
SPAN = FAN**STEPS
PATH = "array<struct<place:int,others:array<string>>>"


def _number(value: int) -> Column:
    return F.lit(value).cast("long")


class Manifest(NamedTuple):
    """Trees reduced to their roots."""

    packs: list[DataFrame]  # per pass, from the leaves up: address, records (digest to children)
    roots: DataFrame  # tree, digest, passes (that led to it)


class Table(NamedTuple):
    """Manifest of a whole table."""

    leaves: DataFrame  # tree, rank (from 0), size (leaves of the tree), digest, extra
    sources: DataFrame  # source, tree
    by_source: Manifest
    top: Manifest  # one tree, 0; its leaves are the subroots
    n_sources: int
    root: str | None  # none for an empty table


def leaf(row: dict[str, Column]) -> Column:
    """Digest of the values of a row: each ``-`` if null, else its length in bytes, ``:`` and itself."""
    parts = []
    for column in row.values():
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _above(nodes: Column) -> Column:
    """Digests of every ``FAN`` consecutive nodes."""
    last = F.ceil(F.size(nodes) / FAN).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), ""), 256))


def _depth(size: Column) -> Column:
    """Levels that a pass puts above a block, for a tree of ``size`` nodes."""
    return sum((F.when(size > FAN**k, 1).otherwise(0) for k in range(STEPS)), F.lit(0))


def build(leaves: DataFrame) -> Manifest:
    """Records and roots of trees; ``leaves``: tree, rank (from 0, without gaps), size, digest. Stored."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    level, packs, roots = leaves.select("tree", "rank", "size", "digest"), [], []
    while True:
        roots.append(level.where("size = 1").select("tree", "digest", F.lit(len(packs)).alias("passes")))
        if most <= 1:
            break
        nodes = F.transform(F.sort_array(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"])
        blocks = (
            level.where("size > 1")
            .groupBy("tree", "size", F.expr(f"rank div {SPAN}").alias("block"))
            .agg(nodes.alias("nodes"))
            .select("tree", "size", "block", F.aggregate(F.sequence(F.lit(1), _depth(F.col("size"))), F.array("nodes"), lambda levels, _: F.concat(levels, F.array(_above(F.element_at(levels, -1))))).alias("levels"))
        )

        def records(k: Column) -> Column:
            below = F.element_at("levels", k)
            return F.transform(F.element_at("levels", k + 1), lambda d, i: F.struct(d.alias("digest"), F.slice(below, i * FAN + 1, FAN).alias("children")))

        stored = durable(
            blocks.select(
                "tree", "size", "block",
                F.element_at(F.element_at("levels", -1), 1).alias("address"),
                F.map_from_entries(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size("levels") - 1), records)))).alias("records"),
            ),
            "merkle-records",
        )
        packs.append(stored.select("address", "records"))
        level = stored.select("tree", F.col("block").alias("rank"), F.ceil(F.col("size") / SPAN).cast("long").alias("size"), F.col("address").alias("digest"))
        most = -(-most // SPAN)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return Manifest(packs, found)


def descend(manifest: Manifest, starts: DataFrame, asked: DataFrame) -> DataFrame:
    """``tree``, ``rank``, ``request``, ``digest`` (of the leaf) and ``path`` (from the root down) of the leaves asked for.

    ``starts``: tree, digest (its root), path (that led to it). ``asked``: tree, rank, size, request, each rank at most once.
    A root that is not the address of a record ends there.
    """
    start = starts.join(manifest.roots.select("tree", "passes"), "tree")
    wanted = asked.groupBy("tree", "size", F.expr(f"rank div {SPAN}").alias("block")).agg(
        F.collect_list(F.struct(F.expr(f"cast(rank % {SPAN} as int)").alias("local"), "request")).alias("below")
    )
    levels = [durable(wanted, "merkle-requests")]
    for _ in manifest.packs[1:]:
        lower = levels[-1].where(f"size > {SPAN}").select("tree", F.ceil(F.col("size") / SPAN).cast("long").alias("size"), "block")
        levels.append(
            lower.groupBy("tree", "size", F.expr(f"block div {SPAN}").alias("above"))
            .agg(F.collect_list(F.struct(F.expr(f"cast(block % {SPAN} as int)").alias("local"), F.lit(None).cast("int").alias("request"))).alias("below"))
            .withColumnRenamed("above", "block")
        )
    powers = F.array(*[F.lit(FAN**k) for k in range(STEPS)])

    def step(at: Column, digit: Column) -> Column:
        children = F.element_at(F.col("records"), at["digest"])
        chosen = F.struct(digit.alias("place"), F.filter(children, lambda _, i: i != digit).alias("others"))
        return F.struct(F.element_at(children, digit + 1).alias("digest"), F.concat(at["path"], F.array(chosen)).alias("path"))

    def leaf_of(one: Column) -> Column:
        digits = F.transform(F.sequence(F.col("depth") - 1, F.lit(0)), lambda k: (F.floor(one["local"] / F.element_at(powers, k + 1)) % FAN).cast("int"))
        at = F.aggregate(digits, F.struct("digest", "path"), step)
        return F.struct(one["local"].alias("local"), one["request"].alias("request"), at["digest"].alias("digest"), at["path"].alias("path"))

    frontier, done = None, None
    for k in range(len(manifest.packs) - 1, -1, -1):
        here = start.where(F.col("passes") == k + 1).select("tree", _number(0).alias("block"), "digest", "path")
        frontier = here if frontier is None else here.unionByName(frontier)
        records = manifest.packs[k].groupBy("address").agg(F.first("records").alias("records"))  # equal addresses, equal records
        opened = frontier.join(records, F.col("digest") == F.col("address")).drop("address")
        found = (
            opened.join(levels[k], ["tree", "block"])
            .withColumn("depth", _depth(F.col("size")))
            .select("tree", (F.col("block") * SPAN).alias("first"), F.explode(F.transform("below", leaf_of)).alias("one"))
            .select("tree", (F.col("first") + F.col("one.local")).alias("rank"), "one.request", "one.digest", "one.path")
        )
        if k:
            frontier = durable(found.select("tree", F.col("rank").alias("block"), "digest", "path"), "merkle-frontier")
        else:
            done = found
    alone = start.where("passes = 0").join(levels[0], "tree").select("tree", F.inline("below"), "digest", "path")
    alone = alone.select("tree", _number(0).alias("rank"), "request", "digest", "path")
    return alone if done is None else done.unionByName(alone)


def manifest(rows: DataFrame) -> Table:
    """The manifest of ``rows``: source, doc_id, digest (of the leaf) and ``extra`` (what a caller wants to keep beside it).

    Leaves ascend by doc_id (null first, then by digest) in every source; sources by their bytes, null first.
    ``rows`` must be stored (they are read several times).
    """
    partitions = partitions_for(rows)
    each = lambda n: min(HOT_ROWS, max(1000, n // partitions))  # noqa: E731  rows of a task; more are cut by range
    count = rows.count()
    names = durable(rows.select("source", F.lit(0).alias("all")).distinct(), "merkle-sources")
    sources = durable(rank_in_group(names, ["all"], [F.col("source")]).select("source", (F.col("position") - 1).alias("tree")), "merkle-sources")
    known = durable(
        rows.join(sources.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
        .select("tree", "doc_id", "digest", "extra", F.monotonically_increasing_id().alias("at")),
        "merkle-leaves",
    )
    ranked = rank_in_group(known, ["tree"], [F.col("doc_id"), F.col("digest"), F.col("at")], each(count))
    leaves = durable(ranked.select("tree", (F.col("position") - 1).alias("rank"), F.col("group_rows").alias("size"), "digest", "doc_id", "extra"), "merkle-leaves")
    by_source = build(leaves)
    n_sources = sources.count()
    subroots = by_source.roots.select(_number(0).alias("tree"), F.col("tree").alias("rank"), _number(n_sources).alias("size"), "digest")
    top = build(durable(subroots, "merkle-subroots"))
    root = top.roots.first()
    return Table(leaves, sources, by_source, top, n_sources, root and root["digest"])


def prove(table: Table, wanted: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``extra``, ``leaf``, ``subroot``, ``root`` and ``path`` (from the leaf to the root) of leaves.

    ``wanted`` (tree, rank) chooses them, all by default. A step of the path has the siblings (``others``)
    and the number of them that stand before (``place``).
    """
    empty = F.array().cast(PATH)
    root = table.top.roots.select("tree", "digest", empty.alias("path"))
    trees = table.sources.select("tree") if wanted is None else wanted.select("tree").distinct()
    size = _number(table.n_sources).alias("size")
    asked = trees.select(_number(0).alias("tree"), F.col("tree").alias("rank"), size, F.lit(None).cast("int").alias("request"))
    reached = durable(descend(table.top, root, asked), "merkle-subroots")
    starts = reached.select(F.col("rank").alias("tree"), "digest", "path")
    leaves = table.leaves if wanted is None else table.leaves.join(wanted.select("tree", "rank"), ["tree", "rank"], "left_semi")
    found = descend(table.by_source, starts, leaves.select("tree", "rank", "size", F.struct("doc_id", "extra").alias("request")))
    subroots = starts.select("tree", F.col("digest").alias("subroot"))
    whole = F.lit(table.root).cast("string").alias("root")
    return found.join(subroots, "tree").select("request.doc_id", "request.extra", F.col("digest").alias("leaf"), "subroot", whole, F.reverse("path").alias("path"))


def siblings(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: s["others"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def up(at: Column, s: Column) -> Column:
        run = F.concat(F.slice(s["others"], F.lit(1), s["place"]), F.array(at), F.slice(s["others"], s["place"] + 1, F.lit(FAN)))
        return F.sha2(F.array_join(run, ""), 256)

    return F.aggregate(path, start, up)


def verify_documents(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, tampered: Column | None = None) -> DataFrame:
    """Proofs of every row of ``docs``, and the root that each leads to if its text is ``tampered``.

    ``tampered`` (an expression over ``docs``) is the text that a reader finds; null means the stored one. Returns doc_id, leaf, subroot,
    root, path, ``found_leaf`` and ``folded_root``. Null values of any column, doc_id and source included, are
    values of their own; repeated rows are leaves of their own; further columns are ignored; an empty table has no root and no rows.
    """
    own = {c: F.col(f"`{c}`") for c in columns}
    edited = leaf(own | {"text": tampered}) if tampered is not None else F.lit(None).cast("string")
    changed = F.when(tampered.isNotNull(), edited) if tampered is not None else edited
    rows = durable(docs.select("source", "doc_id", leaf(own).alias("digest"), changed.alias("extra")), "merkle-rows")
    proven = prove(manifest(rows))
    found = F.coalesce("extra", "leaf")
    return proven.select("doc_id", "leaf", "subroot", "root", "path", found.alias("found_leaf"), folded(found, F.col("path")).alias("folded_root"))
