"""Licence scans and URL filters against their SQL twins, with plans free of Python."""

import duckdb
import pytest
from pyspark.sql import functions as F

from paperlake.llm import licenses, oracles, queries, url_filter


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_is_its_twin(spark, folder, duck, name):
    got = queries.queries()[name](spark, folder)
    want = duck.sql(oracles.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert ordered(got.collect()) == ordered(want.project(", ".join(f'"{c}"' for c in got.columns)).fetchall())


@pytest.mark.parametrize("name", ["op6_licenses", "op9_url_filter"])
def test_plan_has_no_python(spark, folder, name):
    plan = queries.queries()[name](spark, folder)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_urls_of_all_kinds(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme/x"), (4, "HTTP://EXAMPLE.Net/en/x?y#z"), (5, "x://net"), (6, "x://a.net/"), (7, "http://spam-q.org/a/"),
        (8, "https://m.spam-q.org/a?utm_x=1#f"), (9, "http://b://c/d"), (9, "http://b://c/d"), (None, "http://é.org/fr/x\ny?q"), (10, "http://www.spam-q.org/a?b=2&a=1"),
        (11, "ftp://spam-q.org/a?a=1&ref=z&b=2"), (12, "http://notexample.net/en/"), (13, "http://sub.example.net/en/"), (14, "http://example.com/de"), (15, "://"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("block", F.lit(2))
    listed = queries.listed_urls(pages)
    got = url_filter.judge(pages, listed).select("row.page_id", "host", "path", "rule", "verdict").collect()
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", rows)
    want = con.sql(oracles.URL_FILTER).project("page_id, host, path, rule, verdict").fetchall()
    assert ordered(got) == ordered(want)
    assert {r["page_id"]: r["verdict"] for r in got}[8] == "block"
    plain = pages.drop("block")  # a filter beyond the broadcast bound says the same
    bound, url_filter.BROADCAST_BLOCKS = url_filter.BROADCAST_BLOCKS, 0
    try:
        assert ordered(url_filter.judge(plain, listed).select("row.page_id", "host", "path", "rule", "verdict").collect()) == ordered(want)
    finally:
        url_filter.BROADCAST_BLOCKS = bound
    assert url_filter.judge(pages, listed.limit(0)).where("rule is null and verdict = 'block'").count() == 0
    assert url_filter.judge(pages.limit(0), listed).count() == 0


@pytest.mark.parametrize("n", [40, 30_000, 1_000_000])
def test_filter_follows_the_list_and_lets_few_others_pass(spark, n):
    blocks = url_filter.blocks_for(n)
    assert n / 33 < blocks <= n / 32 + 1
    table = url_filter.bloom(spark.range(n).select(F.concat(F.lit("h/"), "id").alias("canonical")), blocks)
    block, bits = url_filter._bits("canonical", blocks)
    hit = F.lit(True)
    for k, bit in enumerate(bits):
        hit = hit & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    probe = spark.range(2 * n).select("id", F.concat(F.lit("h/"), "id").alias("canonical")).withColumn("block", block)
    found = probe.join(table, "block", "left").where(hit)
    listed, others = found.agg(F.count_if(F.col("id") < n), F.count_if(F.col("id") >= n)).first()
    assert listed == n and others <= 0.01 * n + 2


def test_the_list_is_met(spark, folder):
    got = queries.op9_url_filter(spark, folder)
    assert got.where("rule is null and verdict = 'block'").count() > 0


def test_statements(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "nothing\nhere"), ("a/b/c/COPYING.md", "x\n\nLicensed under CC BY-NC 4.0\n"),
        ("a/b/c/d/y.txt", None), ("a/z.py", "// licensed under the APACHE license, version 2.0\ncode"), ("q/x.txt", "the license is unclear and long"), (None, ""), ("top.txt", ""),
        ("a/b/c/LICENCE", "Released under the MIT License"),
    ]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("line", F.lit("clash"))
    found = licenses.statements(files).select("row.path", "license", "score", "line")
    told = {r["path"]: (r["license"], r["line"]) for r in found.collect()}
    assert told["a/LICENSE"] == ("MIT", 1) and told["a/b/c/COPYING.md"] == ("CC-BY-NC-4.0", 3) and told["a/z.py"] == ("Apache-2.0", 1)
    assert told["q/x.txt"] == told[None] == told["a/b/c/d/y.txt"] == (None, None)
    got = {r["path"]: (r["licensed_as"], r["how"], r["from_directory"]) for r in licenses.inherited(found).collect()}
    assert got["a/b/x.txt"] == ("MIT", "inherited", "a")
    assert got["a/b/c/d/y.txt"] == ("MIT", "inherited", "a/b/c")  # equal scores: the later name
    assert got["a/z.py"][:2] == ("Apache-2.0", "header") and got["q/x.txt"] == got[None] == got["top.txt"] == (None, "none", None)
    assert licenses.inherited(licenses.statements(files.limit(0)).select("row.path", "license", "score")).count() == 0
