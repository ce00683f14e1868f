"""Edits as batch jobs: request tables against a snapshot.

Every request has a unique ``seq``; ties in ``requested_at`` fall to it. An operator
gives an outcome per request and, where the tables change, the new snapshot.

First-wins decisions reduce the requests to one winner per key before any join, and
outcomes are joined back on key *and* seq, so a key with very many requests is never
gathered in one place. Look-ups that need the key alone are left to adaptive splitting, or go through ``salted_lookup``.
``add_to_collection`` goes through a key's requests in order instead, unless ``hot_rows`` is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.constants import (
    COLLECTION_KEY,
    DEFAULT_STATUS,
    MEMBERSHIP_KEY,
    NOTE_MAX_LENGTH,
    NOTE_MIN_LENGTH,
    PAPER_KEY,
    STATUSES,
)
from paperlake.functions.text import strip
from paperlake.operators.skew import salted_lookup


def first_requests(requests: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, seq, requests``: the earliest request of each key and how many there are."""
    return (
        requests.groupBy(*keys)
        .agg(F.min(F.struct("requested_at", "seq")).alias("_first"), F.count(F.lit(1)).alias("requests"))
        .select(*keys, F.col("_first.seq").alias("seq"), "requests")
    )


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Whole earliest row of each key; aggregates before the shuffle, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def _looked_up(
    requests: DataFrame, found: DataFrame, keys: list[str], hot_rows: int | None, how: str = "inner", owners: DataFrame | None = None
) -> DataFrame:
    """Requests with their key's row of ``found``, which has one row per key at most (and its number of ``requests``).

    A key with very many requests is split by adaptive execution while the join runs. ``hot_rows`` deals such keys out beforehand
    instead, for sessions without it; that costs one more aggregate over the requests.
    """
    if hot_rows is None:
        return requests.join(found, keys, how)
    return salted_lookup(requests, found, keys, "requests", ["seq"], how, hot_rows=hot_rows, owners=owners)


def _known_key(requests: DataFrame, keys: list[str], table: DataFrame, hot_rows: int | None) -> DataFrame:
    """Add ``known``: does the request's key occur in ``table``, which holds it once at most?"""
    held = table.select(*keys, F.lit(True).alias("known"))
    if hot_rows is not None:
        owners = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"))
        found = _looked_up(requests, owners.join(held, keys, "left"), keys, hot_rows, "left", owners).drop("requests")
    else:
        found = _looked_up(requests, held, keys, None, "left")
    return found.withColumn("known", F.coalesce(F.col("known"), F.lit(False)))


# --- save --------------------------------------------------------------------


def save_papers(requests: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert absent papers, first request wins: outcomes (saved / duplicate) and new snapshot.

    ``requests``: id, seq, requested_at, user_id, guild_id and the paper columns.
    """
    new = first_requests(requests, PAPER_KEY).join(saved.select(*PAPER_KEY), PAPER_KEY, "left_anti")
    new = new.select(*PAPER_KEY, "seq")
    outcomes = (
        requests.select("seq", *PAPER_KEY)
        .join(new.withColumn("_new", F.lit(True)), [*PAPER_KEY, "seq"], "left")
        .select("seq", *PAPER_KEY, F.when(F.col("_new"), "saved").otherwise("duplicate").alias("outcome"))
    )
    # the earliest rows are picked before they move, and whole, so that requests need not meet their winner again
    best = Window.partitionBy(*PAPER_KEY).orderBy("requested_at", "seq")
    added = (
        requests.dropna(subset=PAPER_KEY)
        .withColumn("_rank", F.rank().over(best))
        .where("_rank = 1 and seq is not null")
        .join(saved.select(*PAPER_KEY), PAPER_KEY, "left_anti")
        .withColumns(
            {
                "status": F.lit(DEFAULT_STATUS),
                "note": F.lit(None).cast("string"),
                "saved_at": F.col("requested_at"),
            }
        )
        .select(*saved.columns)
    )
    return outcomes, saved.unionByName(added)


# --- collections -------------------------------------------------------------


def create_collections(requests: DataFrame, collections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes created / blank / duplicate and the new collections table.

    ``requests``: id, seq, requested_at, user_id, guild_id, name.
    """
    cleaned = requests.withColumn("name", strip(F.coalesce(F.col("name"), F.lit(""))))
    named = cleaned.where("name <> ''")
    new = (
        first_requests(named, COLLECTION_KEY)
        .join(collections.select(*COLLECTION_KEY), COLLECTION_KEY, "left_anti")
        .select(*COLLECTION_KEY, "seq")
    )
    outcomes = (
        cleaned.join(new.withColumn("_new", F.lit(True)), [*COLLECTION_KEY, "seq"], "left")
        .select(
            "seq",
            *COLLECTION_KEY,
            F.when(F.col("name") == "", "blank")
            .when(F.col("_new"), "created")
            .otherwise("duplicate")
            .alias("outcome"),
        )
    )
    added = named.join(new, [*COLLECTION_KEY, "seq"]).select(
        "id", *COLLECTION_KEY, F.col("requested_at").alias("created_at")
    )
    return outcomes, collections.select(*added.columns).unionByName(added)


def _clean_membership_requests(requests: DataFrame) -> DataFrame:
    return requests.withColumns({"name": strip(F.col("name")), "paper_id": strip(F.col("paper_id"))})


def add_to_collection(
    requests: DataFrame,
    collections: DataFrame,
    saved: DataFrame,
    memberships: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Outcome per request: not_found before not_saved before duplicate before added.

    ``requests``: seq, requested_at, user_id, guild_id, name, paper_id. The result keeps
    ``collection_id`` and ``requested_at``; its ``added`` rows are the new memberships.

    Requests are shuffled once, to their key, and only keys go to the look-ups. One key's requests are gone through in their order
    by one task, which keeps none of them; ``hot_rows`` deals keys with more requests out instead, and shuffles twice.
    """
    key = [*COLLECTION_KEY, "paper_id"]
    asked = _clean_membership_requests(requests).select("seq", "requested_at", *key)
    if hot_rows is None:
        best = Window.partitionBy(*key).orderBy("requested_at", "seq")
        asked = asked.withColumn("first_seq", F.first("seq").over(best))
        # by the row before and not by a rank, which Spark would cut ahead of a shuffle of its own
        owners = asked.withColumn("_before", F.lag(F.lit(True)).over(best)).where("_before is null").select(*key)
    else:
        owners = first_requests(asked, key).withColumnRenamed("seq", "first_seq")
    resolved = owners.join(
        collections.select(F.col("id").alias("collection_id"), *COLLECTION_KEY), COLLECTION_KEY, "left"
    ).join(saved.select(*PAPER_KEY, F.lit(True).alias("_saved")), PAPER_KEY, "left")
    if memberships is None:
        resolved = resolved.withColumn("_member", F.lit(False))
    else:
        held = memberships.select(*MEMBERSHIP_KEY, F.lit(True).alias("_member"))
        resolved = resolved.join(held, MEMBERSHIP_KEY, "left")
    resolved = resolved.select(
        *owners.columns,
        "collection_id",
        F.when(F.col("collection_id").isNull(), "not_found")
        .when(F.col("_saved").isNull(), "not_saved")
        .when(F.col("_member"), "duplicate")
        .alias("_fixed"),
    )
    return _looked_up(asked, resolved, key, hot_rows, owners=owners).select(
        "seq",
        "requested_at",
        *key,
        "collection_id",
        F.coalesce(
            F.col("_fixed"), F.when(F.col("seq") == F.col("first_seq"), "added").otherwise("duplicate")
        ).alias("outcome"),
    )


def new_memberships(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome") == "added").select(
        "collection_id", *PAPER_KEY, F.col("requested_at").alias("added_at")
    )


def first_memberships(requests: DataFrame, collections: DataFrame, saved: DataFrame) -> DataFrame:
    """What ``add_to_collection`` adds to empty collections: ``new_memberships`` of its outcomes.

    An added row shows when it was first asked for, not by which request, so requests are not told apart.
    """
    key = [*COLLECTION_KEY, "paper_id"]
    undated = F.count_if(F.col("requested_at").isNull()) > 0  # comes first, as in the order of requests
    first = (
        _clean_membership_requests(requests)
        .groupBy(*key)
        .agg(F.when(~undated, F.min("requested_at")).alias("added_at"))
    )
    named = collections.select(F.col("id").alias("collection_id"), *COLLECTION_KEY)
    return (
        first.join(named, COLLECTION_KEY)
        .join(saved.select(*PAPER_KEY), PAPER_KEY, "left_semi")
        .select("collection_id", *PAPER_KEY, "added_at")
    )


def remove_from_collection(
    requests: DataFrame, collections: DataFrame, memberships: DataFrame, hot_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Outcomes not_found / not_in_collection / removed and the remaining memberships.

    The first request for a membership removes it, later ones find nothing.
    """
    key = [*COLLECTION_KEY, "paper_id"]
    asked = _clean_membership_requests(requests).select("seq", "requested_at", *key)
    owners = first_requests(asked, key)
    resolved = (
        owners.withColumnRenamed("seq", "first_seq")
        .join(collections.select(F.col("id").alias("collection_id"), *COLLECTION_KEY), COLLECTION_KEY, "left")
        .join(memberships.select(*MEMBERSHIP_KEY, F.lit(True).alias("_member")), MEMBERSHIP_KEY, "left")
    )
    removed = F.col("_member") & (F.col("seq") == F.col("first_seq"))
    outcomes = _looked_up(asked, resolved, key, hot_rows, owners=owners).select(
        "seq",
        *key,
        F.when(F.col("collection_id").isNull(), "not_found")
        .when(removed, "removed")
        .otherwise("not_in_collection")
        .alias("outcome"),
    )
    gone = resolved.where("_member").select(*MEMBERSHIP_KEY)
    return outcomes, memberships.join(gone, MEMBERSHIP_KEY, "left_anti")


def delete_collections(
    requests: DataFrame, collections: DataFrame, memberships: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcomes deleted / not_found, remaining collections, remaining memberships.

    Memberships go with their collection; the papers stay saved.
    """
    asked = requests.withColumn("name", strip(F.col("name"))).select("seq", "requested_at", *COLLECTION_KEY)
    hits = first_requests(asked, COLLECTION_KEY).join(
        collections.select("id", *COLLECTION_KEY), COLLECTION_KEY
    )
    outcomes = asked.join(
        hits.select(*COLLECTION_KEY, "seq", F.lit(True).alias("_hit")), [*COLLECTION_KEY, "seq"], "left"
    ).select(
        "seq", *COLLECTION_KEY, F.when(F.col("_hit"), "deleted").otherwise("not_found").alias("outcome")
    )
    gone = hits.select("id")
    left = collections.join(gone, "id", "left_anti")
    members = memberships.join(gone.withColumnRenamed("id", "collection_id"), "collection_id", "left_anti")
    return outcomes, left, members


# --- status, note, removal ---------------------------------------------------


def _latest(valid: DataFrame, value: Column, name: str) -> DataFrame:
    """Last valid value per paper key."""
    return valid.groupBy(*PAPER_KEY).agg(
        F.max_by(value, F.struct("requested_at", "seq")).alias(name)
    )


def set_status(
    requests: DataFrame, saved: DataFrame, hot_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Outcomes invalid (checked first) / not_found / updated and the new snapshot."""
    asked = requests.withColumn("paper_id", strip(F.col("paper_id")))
    valid = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    outcomes = _known_key(asked, PAPER_KEY, saved, hot_rows).select(
        "seq",
        *PAPER_KEY,
        "status",
        F.when(~valid, "invalid").when(F.col("known"), "updated").otherwise("not_found").alias("outcome"),
    )
    latest = _latest(asked.where(valid), F.col("status"), "_status")
    changed = (
        saved.join(latest, PAPER_KEY, "left")
        .withColumn("status", F.coalesce(F.col("_status"), F.col("status")))
        .select(*saved.columns)
    )
    return outcomes, changed


def set_note(
    requests: DataFrame, saved: DataFrame, hot_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Outcomes invalid (length before stripping) / not_found / updated and the new snapshot."""
    asked = requests.withColumn("paper_id", strip(F.col("paper_id")))
    valid = F.coalesce(F.length("note").between(NOTE_MIN_LENGTH, NOTE_MAX_LENGTH), F.lit(False))
    outcomes = _known_key(asked, PAPER_KEY, saved, hot_rows).select(
        "seq",
        *PAPER_KEY,
        F.when(~valid, "invalid").when(F.col("known"), "updated").otherwise("not_found").alias("outcome"),
    )
    latest = _latest(asked.where(valid), strip(F.col("note")), "_note")
    changed = (
        saved.join(latest, PAPER_KEY, "left")
        .withColumn("note", F.coalesce(F.col("_note"), F.col("note")))
        .select(*saved.columns)
    )
    return outcomes, changed


def remove_papers(
    requests: DataFrame, saved: DataFrame, memberships: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcomes removed / not_found, remaining papers, remaining memberships.

    Memberships go from all the tenant's collections, also where the paper was not saved.
    """
    asked = requests.withColumn("paper_id", strip(F.col("paper_id"))).select("seq", "requested_at", *PAPER_KEY)
    first = first_requests(asked, PAPER_KEY)
    hits = first.join(saved.select(*PAPER_KEY), PAPER_KEY, "left_semi")
    outcomes = asked.join(
        hits.select(*PAPER_KEY, "seq", F.lit(True).alias("_hit")), [*PAPER_KEY, "seq"], "left"
    ).select("seq", *PAPER_KEY, F.when(F.col("_hit"), "removed").otherwise("not_found").alias("outcome"))
    gone = first.select(*PAPER_KEY)
    return outcomes, saved.join(gone, PAPER_KEY, "left_anti"), memberships.join(gone, PAPER_KEY, "left_anti")


