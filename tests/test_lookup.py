"""Substring look-up through grams against a scan of every item."""

import random

import pytest
from pyspark.sql import functions as F

from paperlake.operators import lookup

ITEMS = "user_id string, guild_id string, item string, at int"
ASKED = "user_id string, guild_id string, needle string"


def scan(items, asked, limit):
    out = []
    for user, guild, needle in dict.fromkeys(asked):
        if needle is None:
            continue
        own = sorted((at, item) for u, g, item, at in items if (u, g) == (user, guild) and item is not None and needle.lower() in item.lower())
        out += [(user, guild, needle, item, k + 1) for k, (_, item) in enumerate(own[:limit])]
    return sorted(out)


@pytest.mark.parametrize("hot_rows", [50, 1_000_000])
def test_lookup_is_a_scan(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(lookup, "BLOCK", 4)
    rng = random.Random(3)
    words = ["".join(rng.choice("abAé%_. ") for _ in range(rng.randrange(0, 9))) for _ in range(150)]
    items = [(f"u{k % 3}", "g", w, k) for k, w in enumerate(words)] + [("u0", "g", None, 900), ("u0", "g", "same", 901), ("u9", "g", "ab", 902)]
    needles = ["", "a", "AB", "ba%", "abab", "b.a", "aaaa", "zzzz", "É", "a_b.", " ", "ab a", "same", "SAMES", None] + [w[1:6] for w in words[:20]]
    asked = [(f"u{k}", "g", n) for k in range(3) for n in needles] + [("nobody", "g", "a"), ("u0", "g", "same")]
    frame = spark.createDataFrame(items, ITEMS)
    for limit in (3, 25):
        index = lookup.gram_index(frame, "item", [F.col("at")], limit, hot_rows)
        got = lookup.find(spark.createDataFrame(asked, ASKED), index, "item", limit, hot_rows)
        assert sorted(tuple(r) for r in got.select("user_id", "guild_id", "needle", "item", "position").collect()) == scan(items, asked, limit)


def test_only_items_of_the_rarest_gram_are_looked_at(spark, monkeypatch):
    items = [("u", "g", f"common {k:05d}", k) for k in range(500)]
    index = lookup.gram_index(spark.createDataFrame(items, ITEMS), "item", [F.col("at")])
    looked: list[int] = []
    hits = lookup._hits

    def counted(opened):
        looked.append(opened.select(F.explode("rows")).count())
        return hits(opened)

    monkeypatch.setattr(lookup, "_hits", counted)
    asked = spark.createDataFrame([("u", "g", "common 00499"), ("u", "g", "commonx"), ("u", "g", "com")], ASKED)
    got = lookup.find(asked, index, "item").collect()
    assert {(r["needle"], r["item"]) for r in got if r["needle"] != "com"} == {("common 00499", "common 00499")}
    assert sum(looked) <= 10  # '499' is in one item, of 'commonx' no gram 'onx' is known, 'com' is answered by its head


def test_a_long_needle_with_many_hits_opens_one_block(spark, monkeypatch):
    items = [("u", "g", f"paper {k}", k) for k in range(600)]
    index = lookup.gram_index(spark.createDataFrame(items, ITEMS), "item", [F.col("at")])
    looked = []
    hits = lookup._hits
    monkeypatch.setattr(lookup, "_hits", lambda opened: looked.append(opened.count()) or hits(opened))
    got = lookup.find(spark.createDataFrame([("u", "g", "PAPER")], ASKED), index, "item").orderBy("position").collect()
    assert [r["item"] for r in got] == [f"paper {k}" for k in range(25)]
    assert looked == [1]


def test_no_items_and_no_requests(spark):
    none = spark.createDataFrame([], ITEMS)
    index = lookup.gram_index(none, "item", [F.col("at")])
    assert lookup.find(spark.createDataFrame([("u", "g", "")], ASKED), index, "item").count() == 0
    assert lookup.find(spark.createDataFrame([], ASKED), index, "item").count() == 0


def test_small_tenants_have_no_grams(spark, monkeypatch):
    items = [(f"u{k % 40}", "g", f"Name {k}", k) for k in range(200)]
    asked = [(f"u{k}", "g", n) for k in range(41) for n in ("", "NAME", "e 1", "9", "name 39x", None)]
    index = lookup.gram_index(spark.createDataFrame(items, ITEMS), "item", [F.col("at")])
    assert index.postings.count() == 0 and index.heads.count() == 0
    for few in (0, lookup.FEW):
        monkeypatch.setattr(lookup, "FEW", few)
        got = lookup.find(spark.createDataFrame(asked, ASKED), index, "item", 3)
        assert sorted(tuple(r) for r in got.select("user_id", "guild_id", "needle", "item", "position").collect()) == scan(items, asked, 3)
