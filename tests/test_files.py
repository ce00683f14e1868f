"""Exact export files: names, contents, repeated runs, lost tasks and aborted jobs."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from paperlake.sources import exports, files
from paperlake.sources.files import NamedFilesWriter, safe_name


def tree(root):
    return {
        os.path.relpath(os.path.join(folder, name), root): open(os.path.join(folder, name)).read()
        for folder, _, names in os.walk(root)
        for name in names
        if not name.startswith(".")  # checksums
    }


@pytest.fixture
def lines(spark):
    rows = [("u1", "", "refs.bib", 1, k, f"@article{{{k}}}" + ("\n" if k < 500 else "")) for k in range(1, 501)]
    rows += [("u1", "g", "refs.bib", 2, 1, "é"), ("u/2", "g", "a/b c.md", 3, 1, "- x\n"), ("u/2", "g", "a/b c.md", 3, 2, "- y"), (None, "g", "..", 4, 1, None)]
    return spark.createDataFrame(rows, "user_id string, guild_id string, file_name string, collection_id long, position long, text string").orderBy(F.rand(3))


WANT = {
    "u=u1/g=/refs.bib": "\n\n".join(f"@article{{{k}}}" for k in range(1, 501)),
    "u=u1/g=g/refs.bib": "é",
    "u=u%2F2/g=g/a%2Fb c.md": "- x\n\n- y",
    "u=/g=g/%2E%2E": "",
}


def test_names_and_contents(lines, tmp_path):
    path = str(tmp_path / "out")
    exports.write_exact_collection_files(lines, path)
    assert tree(path) == WANT and not os.path.exists(f"{path}/_temporary")
    # a second run replaces its own files and leaves the others
    exports.write_exact_collection_files(lines.where("collection_id = 2").withColumn("text", F.lit("new")), f"file://{path}")
    assert tree(path) == WANT | {"u=u1/g=g/refs.bib": "new"}
    exports.write_exact_collection_files(lines.limit(0), path)
    assert len(tree(path)) == len(WANT)


def test_an_aborted_job_leaves_what_was_there(spark, lines, tmp_path):
    path = str(tmp_path / "out")
    exports.write_exact_collection_files(lines.where("collection_id = 2"), path)
    broken = lines.withColumn("text", F.when(F.col("position") == 400, F.raise_error(F.lit("lost"))).otherwise("changed"))
    with pytest.raises(PySparkException):
        exports.write_exact_collection_files(broken, path)
    assert tree(path) == {"u=u1/g=g/refs.bib": "é"}


def test_an_attempt_that_is_not_counted_leaves_nothing(tmp_path):
    def rows(text, fail=False):
        yield {"folder": "f", "file_name": "a.txt", "text": text}
        if fail:
            raise OSError("executor lost")
        yield {"folder": "f", "file_name": "a.txt", "text": "end"}

    writer = NamedFilesWriter(str(tmp_path))
    with pytest.raises(OSError):
        writer.write(rows("half", fail=True))
    twin = writer.write(rows("speculative"))
    counted = writer.write(rows("counted"))
    assert counted.attempt != twin.attempt
    writer.commit([counted, None])
    assert tree(tmp_path) == {"f/a.txt": "counted\nend"}
    other = NamedFilesWriter(str(tmp_path))
    other.abort([other.write(rows("x")), None])
    assert tree(tmp_path) == {"f/a.txt": "counted\nend"}


def test_citation_files(spark, tmp_path):
    payloads = spark.createDataFrame(
        [("file", "long text\nof two lines", "p1.bib"), ("file", "long text\nof two lines", "p1.bib"), ("inline", "short", "p2.bib")], "delivery string, citation string, file_name string"
    )
    exports.write_exact_citation_files(payloads, str(tmp_path / "cited"))
    assert tree(tmp_path / "cited") == {"p1.bib": "long text\nof two lines"}


def test_names_that_no_file_can_have():
    assert [safe_name(n) for n in ("a.bib", "a/b", "..", ".", "", "x\0")] == ["a.bib", "a%2Fb", "%2E%2E", "%2E", "%", "x%00"]


def test_overwrite_is_refused(spark, tmp_path):
    spark.dataSource.register(files.NamedFiles)
    rows = spark.createDataFrame([("", "a", "b")], files.SCHEMA)
    with pytest.raises(PySparkException):
        rows.write.format(files.NAME).mode("overwrite").option("path", str(tmp_path)).save()
