"""Edits against a step-by-step model, with plain and with hot-key plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paperlake.operators import mutations
from paperlake.sources import schemas

T0 = dt.datetime(2024, 1, 1)


def when(n):
    return T0 + dt.timedelta(minutes=n)


def saved_row(user, paper):
    return {
        "id": 0, "user_id": user, "guild_id": "g", "paper_id": paper, "title": "t", "authors": "[]",
        "arxiv_url": "u", "status": "to-read", "note": "old", "saved_at": T0,
    }


@pytest.fixture(scope="module")
def state(spark):
    saved = spark.createDataFrame([saved_row("u", "p1"), saved_row("u", "p2"), saved_row("v", "p1")], schemas.SAVED_PAPERS)
    named = spark.createDataFrame([(1, "u", "g", "refs", T0), (2, "v", "g", "refs", T0)], schemas.COLLECTIONS)
    members = spark.createDataFrame(
        [(1, "p1", "u", "g", T0), (2, "p1", "v", "g", T0), (1, "p9", "u", "g", T0)], schemas.COLLECTION_PAPERS
    )
    return saved, named, members


def asked(spark, data, extra):
    fields = "seq long, requested_at timestamp, user_id string, guild_id string"
    return spark.createDataFrame([(i, when(m), u, "g", *rest) for i, m, u, *rest in data], f"{fields}, {extra}")


def outcomes(df):
    return [r.outcome for r in df.orderBy("seq").collect()]


def test_save_papers(spark, state):
    saved = state[0]
    reqs = asked(spark, [(1, 5, "u", "p1"), (2, 4, "u", "p3"), (3, 3, "u", "p3"), (4, 3, "v", "p2"), (5, 3, "v", "p2")], "paper_id string")
    paper = saved.where("user_id = 'u' and paper_id = 'p1'").drop("user_id", "guild_id", "paper_id", "id", "status", "note", "saved_at")
    reqs = reqs.crossJoin(paper).withColumn("id", reqs.seq)
    out, new = mutations.save_papers(reqs, saved)
    assert outcomes(out) == ["duplicate", "duplicate", "saved", "saved", "duplicate"]
    added = {(r.user_id, r.paper_id): r for r in new.where("id > 0").collect()}
    assert set(added) == {("u", "p3"), ("v", "p2")} and new.count() == 5
    row = added[("u", "p3")]
    assert (row.id, row.status, row.note, row.saved_at) == (3, "to-read", None, when(3))


def test_create_collections(spark, state):
    reqs = asked(
        spark, [(1, 1, "u", "   "), (2, 1, "u", " refs"), (3, 2, "u", "Refs"), (4, 1, "u", "Refs "), (5, 1, "w", ""), (6, 9, "w", "refs")],
        "name string",
    )
    out, new = mutations.create_collections(reqs.withColumn("id", reqs.seq + 100), state[1])
    assert outcomes(out) == ["blank", "duplicate", "duplicate", "created", "blank", "created"]
    assert {(r.id, r.name) for r in new.where("id > 100").collect()} == {(104, "Refs"), (106, "refs")}


@pytest.mark.parametrize("hot_rows", [None, 1_000_000, 1])
def test_add_to_collection(spark, state, hot_rows):
    saved, named, members = state
    reqs = asked(
        spark,
        [(1, 1, "u", "nope", "p9"), (2, 1, "u", "refs", "zz"), (3, 1, "u", "refs", "p1"), (4, 3, "u", " refs", "p2 "),
         (5, 2, "u", "refs", "p2"), (6, 3, "u", "refs", "p2"), (7, 1, "u", "refs", "p9")],
        "name string, paper_id string",
    )
    out = mutations.add_to_collection(reqs, named, saved, members, hot_rows=hot_rows)
    assert outcomes(out) == ["not_found", "not_saved", "duplicate", "duplicate", "added", "duplicate", "not_saved"]
    new = mutations.new_memberships(out).collect()
    assert [(r.collection_id, r.paper_id, r.added_at) for r in new] == [(1, "p2", when(2))]


def test_first_memberships_are_the_added_ones(spark, state, rows):
    saved, named, _ = state
    data = [
        (1, 5, "u", "refs", "p1"), (2, 3, "u", " refs", "p1 "), (3, 4, "u", "none", "p1"), (4, 2, "u", "refs", "p9"),
        (5, 9, "v", "refs", "p1"), (6, 1, "v", None, "p1"),
    ]
    requests = asked(spark, data, "name string, paper_id string")
    undated = requests.withColumn("requested_at", F.when(F.col("seq") != 5, F.col("requested_at")))
    for given in (requests, undated.unionByName(requests.withColumn("seq", F.col("seq") + 10))):
        want = mutations.new_memberships(mutations.add_to_collection(given, named, saved))
        assert rows(mutations.first_memberships(given, named, saved), *want.columns) == rows(want)
        assert want.count() == 2


@pytest.mark.parametrize("hot_rows", [None, 1_000_000, 1])
def test_remove_from_collection(spark, state, hot_rows):
    _, named, members = state
    reqs = asked(
        spark, [(1, 2, "u", "refs", "p1"), (2, 1, "u", "refs", "p1"), (3, 1, "u", "nope", "p1"), (4, 1, "u", "refs", "p2")],
        "name string, paper_id string",
    )
    out, left = mutations.remove_from_collection(reqs, named, members, hot_rows=hot_rows)
    assert outcomes(out) == ["not_in_collection", "removed", "not_found", "not_in_collection"]
    assert {(r.collection_id, r.paper_id) for r in left.collect()} == {(2, "p1"), (1, "p9")}


@pytest.mark.parametrize("hot_rows", [None, 1_000_000, 1])
def test_set_status(spark, state, hot_rows):
    reqs = asked(
        spark, [(1, 3, "u", " p1", "done"), (2, 4, "u", "p1", "invalid-status"), (3, 2, "u", "p1", "reading"),
                (4, 1, "u", "zz", "done"), (5, 1, "u", "zz", None), (6, 1, "v", "p1", "to-read")],
        "paper_id string, status string",
    )
    out, new = mutations.set_status(reqs, state[0], hot_rows)
    assert outcomes(out) == ["updated", "invalid", "updated", "not_found", "invalid", "updated"]
    assert {(r.user_id, r.paper_id): r.status for r in new.collect()} == {
        ("u", "p1"): "done", ("u", "p2"): "to-read", ("v", "p1"): "to-read",
    }


def test_set_note(spark, state):
    reqs = asked(
        spark, [(1, 1, "u", "p1", " Great paper! "), (2, 1, "u", "p2", "   "), (3, 1, "v", "p1", ""), (4, 1, "v", "p1", "x" * 501), (5, 1, "u", "zz", "a")],
        "paper_id string, note string",
    )
    out, new = mutations.set_note(reqs, state[0])
    assert outcomes(out) == ["updated", "updated", "invalid", "invalid", "not_found"]
    assert {(r.user_id, r.paper_id): r.note for r in new.collect()} == {
        ("u", "p1"): "Great paper!", ("u", "p2"): "", ("v", "p1"): "old",
    }


def test_remove_papers_cleans_memberships(spark, state):
    saved, _, members = state
    reqs = asked(spark, [(1, 1, "u", "p1"), (2, 2, "u", "p1"), (3, 1, "u", "p9"), (4, 1, "w", "p1")], "paper_id string")
    out, left, kept = mutations.remove_papers(reqs, saved, members)
    assert outcomes(out) == ["removed", "not_found", "not_found", "not_found"]
    assert {(r.user_id, r.paper_id) for r in left.collect()} == {("u", "p2"), ("v", "p1")}
    assert {(r.collection_id, r.paper_id) for r in kept.collect()} == {(2, "p1")}


def test_delete_collections_cascades(spark, state):
    _, named, members = state
    reqs = asked(spark, [(1, 2, "u", "refs"), (2, 1, "u", " refs "), (3, 1, "w", "refs")], "name string")
    out, left, kept = mutations.delete_collections(reqs, named, members)
    assert outcomes(out) == ["not_found", "deleted", "not_found"]
    assert [r.id for r in left.collect()] == [2] and [r.collection_id for r in kept.collect()] == [2]


def test_random_adds_follow_the_model(spark, state):
    rng = random.Random(5)
    data = [(i, rng.randrange(30), rng.choice("uv"), rng.choice(["refs", "nope"]), rng.choice(["p1", "p2", "p9"])) for i in range(300)]
    saved, named, _ = state
    held, ids, expected = {("u", "p1"), ("u", "p2"), ("v", "p1")}, {("u", "refs"), ("v", "refs")}, {}
    members = set()
    for i, m, u, name, p in sorted(data, key=lambda r: (r[1], r[0])):
        if (u, name) not in ids:
            expected[i] = "not_found"
        elif (u, p) not in held:
            expected[i] = "not_saved"
        else:
            expected[i] = "duplicate" if (u, name, p) in members else "added"
            members.add((u, name, p))
    reqs = asked(spark, data, "name string, paper_id string")
    for hot_rows in (None, 1_000_000, 20):
        out = mutations.add_to_collection(reqs, named, saved, hot_rows=hot_rows)
        assert {r.seq: r.outcome for r in out.collect()} == expected


def test_adds_shuffle_the_requests_once(spark, state):
    """The look-ups get the keys of the shuffle that the outcomes come from."""
    saved, named, members = state
    reqs = asked(spark, [(k, k, "u", "refs", "p2") for k in range(9)], "name string, paper_id string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = mutations.add_to_collection(reqs, named, saved, members)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "ReusedExchange" in plan and "HashAggregate" not in plan and "SortAggregate" not in plan


def test_saved_rows_are_picked_before_they_move(spark, state):
    """One shuffle brings the requests to their papers; rows without a whole key or seq are not saved, the first may come twice."""
    saved = state[0]
    row = saved.where("user_id = 'u' and paper_id = 'p1'").drop("user_id", "guild_id", "paper_id", "id", "status", "note", "saved_at")
    data = [(3, 3, "u", "p3"), (3, 3, "u", "p3"), (1, 4, "u", "p3"), (2, 1, "u", None), (None, 1, "v", "p2"), (4, 2, "v", "p2"), (5, 1, "u", "p1")]
    reqs = asked(spark, data, "paper_id string").crossJoin(row).withColumn("id", F.col("seq") + 10)
    new = mutations.save_papers(reqs, saved)[1].where("id > 0")
    assert [(r.id, r.user_id, r.paper_id, r.saved_at) for r in new.collect()] == [(13, "u", "p3", when(3))] * 2
    assert "WindowGroupLimit" in new._jdf.queryExecution().optimizedPlan().toString()
