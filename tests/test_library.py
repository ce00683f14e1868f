"""Small literal libraries: listings, look-ups, counts, collections, export, checks, layouts."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from paperlake.operators import collections, layout, library, quality
from paperlake.sources import exports, schemas, tables


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def saved_row(i, user, guild, paper, when, **changes):
    row = {
        "id": i, "user_id": user, "guild_id": guild, "paper_id": paper, "title": f"Title {paper}",
        "authors": '["Doe, Jr.", "Alice Smith"]', "summary": None, "published": "2024-01-01",
        "categories": "cs.AI, cs.CL", "arxiv_url": f"https://arxiv.org/abs/{paper}", "pdf_url": None, "doi": None,
        "status": "to-read", "note": None, "saved_at": at(when),
    }
    return {**row, **changes}


@pytest.fixture(scope="module")
def saved(spark):
    data = [
        saved_row(1, "u1", "g1", "2401.00001", 1),
        saved_row(2, "u1", "g1", "2401.00002", 2, status="done", note="fine", categories='["cs.AI", "cs.AI"]'),
        saved_row(3, "u1", "g1", "hep-th/9901001", 2, status="reading", categories=None),
        saved_row(4, "u1", "", "2401.00001", 3),
        saved_row(5, "u2", "g1", "2401.00002", 4, status="done"),
    ]
    return spark.createDataFrame(data, schemas.SAVED_PAPERS)


@pytest.fixture(scope="module")
def named(spark):
    data = [
        (1, "u1", "g1", "refs", at(1)), (2, "u1", "g1", "Empty", at(2)), (3, "u2", "g1", "refs", at(3)),
        (4, "u3", "", "later", at(4)),
    ]
    return spark.createDataFrame(data, schemas.COLLECTIONS)


@pytest.fixture(scope="module")
def members(spark):
    data = [
        (1, "2401.00001", "u1", "g1", at(5)), (1, "2401.00002", "u1", "g1", at(6)), (1, "gone", "u1", "g1", at(7)),
        (3, "2401.00002", "u2", "g1", at(8)),
    ]
    return spark.createDataFrame(data, schemas.COLLECTION_PAPERS)


def test_listing_decodes_and_orders(saved):
    out = library.in_listing_order(library.listing(saved)).where("user_id = 'u1' and guild_id = 'g1'").collect()
    assert [r.paper_id for r in out] == ["2401.00002", "hep-th/9901001", "2401.00001"]
    assert out[2].authors == ["Doe, Jr.", "Alice Smith"] and out[2].categories == ["cs.AI", "cs.CL"]
    assert out[2].summary == "" and out[2].doi == "" and out[2].note is None and out[1].categories == []


def test_tenants_are_apart(saved, rows):
    assert library.for_tenant(saved, "u1").count() == 1
    assert library.for_tenant(saved, "u1", "g1").count() == 3
    assert library.for_tenant(saved, "u1", "g3").count() == 0
    assert rows(library.by_status(saved, "done"), "user_id") == [("u1",), ("u2",)]
    assert library.by_status(saved, "unheard-of").count() == 0


def test_exists_and_notes(spark, saved, rows):
    asked = spark.createDataFrame(
        [("u1", "g1", "2401.00001"), ("u1", "g1", "2401.00002"), ("u1", "g2", "2401.00001")],
        "user_id string, guild_id string, paper_id string",
    )
    assert rows(library.paper_exists(asked, saved), "guild_id", "paper_id", "saved") == [
        ("g1", "2401.00001", True), ("g1", "2401.00002", True), ("g2", "2401.00001", False),
    ]
    assert rows(library.notes(asked, saved), "guild_id", "paper_id", "note", "state") == [
        ("g1", "2401.00001", "", "no_note"), ("g1", "2401.00002", "fine", "note"),
        ("g2", "2401.00001", None, "not_saved"),
    ]


def test_suggestions(spark, saved, named, rows):
    asked = spark.createDataFrame(
        [("u1", "g1", "HEP"), ("u1", "g1", ""), ("u1", "g1", "%"), ("u2", "g1", "401")],
        "user_id string, guild_id string, needle string",
    )
    assert rows(library.suggest_paper_ids(asked, saved), "needle", "position", "paper_id") == [
        ("", 1, "2401.00002"), ("", 2, "hep-th/9901001"), ("", 3, "2401.00001"),
        ("401", 1, "2401.00002"), ("HEP", 1, "hep-th/9901001"),
    ]
    assert rows(collections.suggest_names(asked, named), "needle", "position", "name") == [
        ("", 1, "Empty"), ("", 2, "refs"),
    ]


def test_suggestions_stop_at_25(spark):
    many = spark.range(60).select(
        F.lit("u").alias("user_id"), F.lit("").alias("guild_id"), F.format_string("p%02d", "id").alias("paper_id"),
        F.timestamp_seconds("id").alias("saved_at"),
    )
    asked = spark.createDataFrame([("u", "", "P")], "user_id string, guild_id string, needle string")
    got = library.suggest_paper_ids(asked, many).orderBy("position").collect()
    assert [r.paper_id for r in got] == [f"p{i:02d}" for i in range(59, 34, -1)]


def test_counts(spark, saved, named, rows):
    tenants = spark.createDataFrame([("u1", "g1"), ("u9", "")], "user_id string, guild_id string")
    assert rows(library.sizes(saved, tenants)) == [("u1", "g1", 3), ("u9", "", 0)]
    assert rows(library.status_counts_filled(saved)) == [("u1", "", 1, 0, 0), ("u1", "g1", 1, 1, 1), ("u2", "g1", 0, 0, 1)]
    stats = {(r.user_id, r.guild_id): r for r in library.stats(saved, named).collect()}
    one = stats[("u1", "g1")]
    assert (one.total, one.to_read, one.reading, one.done, one.collections_count) == (3, 1, 1, 1, 2)
    assert [tuple(c) for c in one.top_categories] == [("cs.AI", 3), ("cs.CL", 1)]
    only_named = stats[("u3", "")]
    assert (only_named.total, only_named.collections_count, only_named.top_categories) == (0, 1, [])


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_pages(spark, hot_rows):
    held = spark.range(12).select(
        F.lit("u").alias("user_id"), F.lit("").alias("guild_id"), F.format_string("p%02d", "id").alias("paper_id"),
        F.timestamp_seconds(F.col("id") % 4).alias("saved_at"),
    )
    got = library.pages(held, hot_rows=hot_rows).orderBy("idx").collect()
    order = sorted(range(12), key=lambda i: (-(i % 4), i))
    assert [r.paper_id for r in got] == [f"p{i:02d}" for i in order]
    assert [(r.idx, r.page) for r in got] == [(i + 1, i // 5 + 1) for i in range(12)]
    assert {(r.total, r.total_pages) for r in got} == {(12, 3)}


def test_collection_counts_keep_orphans_contents_do_not(saved, named, members, rows):
    assert rows(collections.counts(named, members), "id", "paper_count") == [(1, 3), (2, 0), (3, 1), (4, 0)]
    contents = collections.papers(members, saved)
    assert rows(contents, "collection_id", "paper_id") == [(1, "2401.00001"), (1, "2401.00002"), (3, "2401.00002")]
    assert contents.where("collection_id = 3").first().summary is None
    head = collections.head(contents, rows=1)
    assert rows(head, "collection_id", "paper_id", "total") == [(1, "2401.00002", 2), (3, "2401.00002", 1)]


def test_collection_states(spark, saved, named, members, rows):
    asked = spark.createDataFrame(
        [("u1", "g1", " refs "), ("u1", "g1", "Empty"), ("u1", "g1", "empty"), ("u2", "g2", "refs")],
        "user_id string, guild_id string, name string",
    )
    got = collections.states(asked, named, members, saved)
    assert rows(got, "guild_id", "name", "state") == [
        ("g1", "Empty", "empty"), ("g1", "empty", "missing"), ("g1", "refs", "ok"), ("g2", "refs", "missing"),
    ]


def test_export_routing_and_files(spark, saved, named, members, tmp_path):
    cited = collections.citations(collections.papers(members, saved), named, "plain")
    out = {r.collection_id: r for r in collections.export(cited).collect()}
    line = "Doe, Jr., Alice Smith (2024). Title {0}. arXiv:{0}."
    joined = line.format("2401.00002") + "\n\n" + line.format("2401.00001")
    assert out[1].payload == f"**2** citations from **refs**\n```\n{joined}\n```"
    assert (out[1].delivery, out[1].text_length, out[1].file_name) == ("inline", len(joined), "refs.txt")

    path = str(tmp_path / "files")
    exports.write_collection_files(collections.export_lines(cited, hot_rows=1), path)
    folder = f"{path}/user_id=u%3Au1/guild_id=g%3Ag1/file_name=refs.txt"
    parts = sorted(glob.glob(f"{folder}/*.txt"))
    assert "".join(open(p).read() for p in parts) == joined + "\n"


def test_export_of_members_without_texts(saved, named, members, rows):
    cited = collections.citations(collections.papers(members, saved), named, "plain")
    held = collections.members(members, saved.select("user_id", "guild_id", "paper_id"))
    slim = collections.named_members(held, named, "plain")
    texts = collections.paper_citations(saved.dropDuplicates(["paper_id"]), "plain")
    assert "citation" not in slim.columns
    for made in (collections.export, collections.export_lines):
        want = made(cited)
        assert rows(made(slim, texts=texts), *want.columns) == rows(want)


def test_citation_files_and_packed_lines(spark, saved, named, members, tmp_path):
    payloads = spark.createDataFrame(
        [("file", "long text\nof two lines", "p1.bib"), ("inline", "short", "p2.bib")], "delivery string, citation string, file_name string"
    )
    exports.write_citation_files(payloads, str(tmp_path / "cited"))
    folders = glob.glob(str(tmp_path / "cited/*/*.txt"))
    assert len(folders) == 1 and "file_name=p1.bib" in folders[0]
    assert open(folders[0]).read() == "long text\nof two lines\n"

    cited = collections.citations(collections.papers(members, saved), named, "plain")
    lines = collections.export_lines(cited)
    exports.write_packed(lines, str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, lines.collect()))


def test_top_categories_of_a_tenant_with_collections_only(spark, saved, named):
    lonely = spark.createDataFrame([(99, "nobody", "g", "mine")], "id long, user_id string, guild_id string, name string")
    got = library.stats(saved, named.select("id", "user_id", "guild_id", "name").unionByName(lonely)).where("user_id = 'nobody'").first()
    assert got.top_categories == [] and got.collections_count == 1


def test_export_of_a_long_collection_is_a_file(spark, named):
    contents = spark.range(40).select(
        F.lit(1).cast("long").alias("collection_id"), F.lit("u1").alias("user_id"), F.lit("g1").alias("guild_id"),
        F.format_string("p%02d", "id").alias("paper_id"), F.repeat(F.lit("t"), 60).alias("title"),
        F.array(F.lit("A")).alias("authors"), F.lit("").alias("published"), F.array(F.lit("c")).alias("categories"),
        F.lit("url").alias("arxiv_url"), F.lit("").alias("doi"), F.timestamp_seconds("id").alias("added_at"),
    )
    out = collections.export(collections.citations(contents, named, "markdown")).first()
    assert out.delivery == "file" and out.payload is None and out.papers == 40 and out.file_name == "refs.md"


def test_snapshot_round_trip(spark, saved, named, members, tmp_path, rows):
    path = str(tmp_path / "snapshot")
    tables.write_snapshot({"saved_papers": saved, "collections": named, "collection_papers": members}, path)
    back = tables.read_tables(spark, path)
    assert rows(back["saved_papers"]) == rows(saved) and rows(back["collection_papers"]) == rows(members)
    plan = library.for_tenant(back["saved_papers"], "u1", "g1").select("paper_id")._jdf.queryExecution().toString()
    assert "EqualTo(user_id,u1)" in plan and "ReadSchema: struct<user_id:string,guild_id:string,paper_id:string>" in plan


def test_quality(spark, saved, named, members, rows):
    twice = saved.unionByName(saved.where("id = 5"))
    assert rows(quality.duplicate_keys(twice, quality.KEYS["saved_papers"])) == [("u2", "g1", "2401.00002", 2)]
    holes = saved.withColumn("title", F.when(F.col("id") > 2, F.col("title")))
    found = {r.column_name: r.violations for r in quality.null_violations(holes, schemas.SAVED_PAPERS, "t").collect()}
    assert found["title"] == 2 and found["user_id"] == 0 and "note" not in found
    assert rows(quality.orphan_memberships(members, named.where("id <> 3"), saved), "collection_id", "paper_id", "reason") == [
        (1, "gone", "no_paper"), (3, "2401.00002", "no_collection"),
    ]
    odd = saved.withColumn("status", F.when(F.col("id") == 1, "archived").when(F.col("id") > 2, F.col("status")))
    assert rows(quality.bad_status(odd), "id") == [(1,), (2,)]


def test_layout_upgrades(saved, named, members):
    old = saved.drop("status", "note", "summary", "guild_id")
    tables_ = {
        "saved_papers": old, "collections": named.drop("guild_id"), "collection_papers": members.drop("guild_id")
    }
    new = layout.upgrade(tables_)
    row = new["saved_papers"].first()
    assert (row.status, row.note, row.summary, row.guild_id) == ("to-read", None, None, "")
    assert all("guild_id" in df.columns for df in new.values())
    again = layout.upgrade(new)
    assert all(again[name] is new[name] for name in new)
