"""Pages through counts of ordered chunks against plain paging."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from paperlake.constants import TENANT
from paperlake.operators import library, page_index


@pytest.fixture(scope="module")
def held(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("hot", "", f"p{k:03d}", start + dt.timedelta(minutes=k // 4)) for k in range(203)]
    rows += [("few", "g", f"q{k}", start) for k in range(5)] + [("one", "g", "r", None)]
    return spark.createDataFrame(rows, "user_id string, guild_id string, paper_id string, saved_at timestamp")


@pytest.mark.parametrize("size, hot_rows", [(7, 1_000_000), (16, 50), (1024, 1_000_000)])
@pytest.mark.parametrize("per_page", [5, 40])
def test_every_page_is_that_of_plain_paging(held, rows, size, hot_rows, per_page):
    index = page_index.page_index(held, TENANT, library.newest_first(), size, hot_rows)
    plain = library.pages(held, per_page)
    got = page_index.find_pages(plain.select(*TENANT, "page"), index, per_page)
    assert rows(got, *sorted(plain.columns)) == rows(plain, *sorted(plain.columns))
    assert index.chunks.where(F.size("rows") > size).count() == 0


def test_one_page_reads_its_chunk_only(spark, held, rows, tmp_path):
    page_index.store(page_index.page_index(held, TENANT, library.newest_first(), 10), str(tmp_path))
    index = page_index.stored(spark, str(tmp_path), TENANT, 10)
    plain = library.pages(held)
    for group, page in (({"user_id": "hot", "guild_id": ""}, 7), ({"user_id": "hot", "guild_id": ""}, 41), ({"user_id": "one", "guild_id": "g"}, 1)):
        got = page_index.one_page(index, group, page)
        want = plain.where((F.col("user_id") == group["user_id"]) & (F.col("page") == page))
        assert rows(got, *sorted(plain.columns)) == rows(want, *sorted(plain.columns))
    plan = page_index.one_page(index, {"user_id": "hot", "guild_id": ""}, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"chunk#\d+L? = 3\b", plan)
    assert page_index.one_page(index, {"user_id": "hot", "guild_id": ""}, 42).count() == 0
    assert page_index.one_page(index, {"user_id": "nobody", "guild_id": ""}, 1).count() == 0


def test_pages_that_do_not_exist_and_empty_tables(spark, held):
    index = page_index.page_index(held, TENANT, library.newest_first(), 8)
    asked = spark.createDataFrame([("few", "g", 2), ("few", "g", 0), ("few", "g", None), ("none", "", 1), ("few", "g", 1), ("few", "g", 1)], "user_id string, guild_id string, page int")
    assert page_index.find_pages(asked, index).count() == 5
    empty = page_index.page_index(held.limit(0), TENANT, library.newest_first())
    assert page_index.find_pages(asked, empty).count() == 0


def test_many_requests_to_one_group_do_not_meet_all_its_chunks(held):
    index = page_index.page_index(held, TENANT, library.newest_first(), 8)
    plan = page_index.find_pages(library.pages(held).select(*TENANT, "page"), index)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*stretch#\d+L? = stretch#\d+", plan)
