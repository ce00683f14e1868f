"""Data source ``named_text_files``: every file is written under its own name.

Rows have ``folder``, ``file_name`` and ``text``; rows of a file come together and in order, and its content is
their texts with a line end between two of them. A task writes its files below a folder of its own attempt under
``_temporary``; the job's commit moves the files of the attempts that succeeded into place and removes the rest.
So a lost task or an aborted job leaves no half-written file, and none of an attempt that is not counted. The driver
handles names only, one folder of a task at a time.

A file has one writer: its rows pass one task as a stream, whatever its length.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

NAME = "named_text_files"
SCHEMA = "folder string, file_name string, text string"


def safe_name(name: str) -> str:
    """The name itself but for what no file name can hold: ``/``, the null character, ``.`` and ``..``."""
    if name in ("", ".", ".."):
        return name.replace(".", "%2E") or "%"
    return name.replace("/", "%2F").replace("\0", "%00")


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    attempt: str


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        self.job = f"_temporary/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = file_system(self.path)
        attempt = f"{self.job}/{uuid.uuid4().hex}"
        for (folder, name), rows in groupby(iterator, key=lambda r: (r["folder"] or "", r["file_name"])):
            place = posixpath.join(root, attempt, folder)
            store.create_dir(place, recursive=True)
            with store.open_output_stream(posixpath.join(place, safe_name(name))) as out:
                for k, row in enumerate(rows):
                    out.write((("\n" if k else "") + (row["text"] or "")).encode())
        return Written(attempt)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        for message in messages:
            if message is not None:
                self._place(store, f"{root}/{message.attempt}", root)
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))

    def _place(self, store: arrow_fs.FileSystem, source: str, target: str) -> None:
        for found in store.get_file_info(arrow_fs.FileSelector(source, allow_not_found=True)):
            place = f"{target}/{found.base_name}"
            if found.type == arrow_fs.FileType.Directory:
                store.create_dir(place, recursive=True)
                self._place(store, found.path, place)
            else:
                if store.get_file_info(place).type != arrow_fs.FileType.NotFound:
                    store.delete_file(place)  # some stores do not move onto a file
                store.move(found.path, place)

    def _clear(self, store: arrow_fs.FileSystem, root: str) -> None:
        jobs = f"{root}/_temporary"
        if store.get_file_info(f"{root}/{self.job}").type != arrow_fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")
            if not store.get_file_info(arrow_fs.FileSelector(jobs)):
                store.delete_dir(jobs)


class NamedFiles(DataSource):
    """Option ``path``: the folder to write to. Files of earlier runs stay unless they are written again."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        if overwrite:
            raise ValueError(f"{NAME} appends: it replaces the files that it writes and leaves others")
        return NamedFilesWriter(self.options["path"])
