"""Hot groups: the special paths must give what the plain ones give."""

import random

from pyspark.sql import functions as F

from paperlake.operators.skew import hot_groups, ordered_chunks, rank_in_group, salted_lookup


def skewed(spark, n=900):
    """One group holds most rows, many of them with the same order value."""
    rng = random.Random(7)
    data = [("hot" if i % 3 else f"g{i % 40}", rng.randrange(5), i) for i in range(n)]
    return spark.createDataFrame(data, "k string, at int, id int"), data


def test_rank_in_group_of_any_size(spark, rows):
    df, data = skewed(spark)
    groups = {}
    for k, at, i in data:
        groups.setdefault(k, []).append((-at, i))
    expected = sorted(
        (i, k, p, len(g)) for k, g in groups.items() for p, (_, i) in enumerate(sorted(g), 1)
    )
    order = [F.desc("at"), F.asc("id")]
    for hot_rows in (10_000, 50, 10):
        got = rank_in_group(df, ["k"], order, hot_rows)
        assert sorted((r.id, r.k, r.position, r.group_rows) for r in got.collect()) == expected


def test_chunks_are_bounded_and_ordered(spark):
    df, _ = skewed(spark)
    chunked, split = ordered_chunks(df, ["k"], [F.asc("at"), F.asc("id")], hot_rows=100)
    assert split
    hot = [r for r in chunked.where("k = 'hot'").collect()]
    sizes = {}
    for r in hot:
        sizes.setdefault(r.chunk, []).append((r.at, r.id))
    assert len(sizes) > 3 and max(len(v) for v in sizes.values()) < 300
    flat = [x for chunk in sorted(sizes) for x in sorted(sizes[chunk])]
    assert flat == sorted(flat)
    assert chunked.where("k <> 'hot'").select("chunk").distinct().count() == 1


def test_salted_lookup_matches_plain_join(spark, rows):
    df, _ = skewed(spark)
    small = df.groupBy("k").agg(F.count("*").alias("n"), F.max("at").alias("top")).where("k <> 'g3'")
    for how in ("inner", "left"):
        plain = rows(df.join(small, ["k"], how), "k", "id", "top")
        for hot_rows in (10_000, 100, 1):
            got = salted_lookup(df, small, ["k"], "n", ["id"], how=how, hot_rows=hot_rows)
            assert rows(got, "k", "id", "top") == plain


def test_salted_lookup_spreads_the_hot_key(spark):
    df, _ = skewed(spark)
    small = df.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = salted_lookup(df, small, ["k"], "n", ["id"], hot_rows=50)
        parts = got.where("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert parts > 1


def test_hot_groups(spark):
    df, data = skewed(spark)
    hot = hot_groups(df, ["k"], 100)
    assert (hot.count, hot.rows, hot.all_rows) == (1, sum(k == "hot" for k, _, _ in data), len(data))
