"""A sink for whole files: rows (file, content) become files under a folder, all of them or none.

Tasks write into a pending folder of their job; only the commit moves files to their names, and an aborted job takes its
pending folder away. So a task that fails, or one that runs twice, leaves nothing behind. Any file system that pyarrow
opens by its address will do: local ones, HDFS and object stores.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "foliant_files"


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (pending name, name)."""

    files: list[tuple[str, str]]


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder by its address; one without a scheme is a local path."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def inside(name: str) -> str:
    """A file's name within the folder; one that leads out of it is an error."""
    clean = posixpath.normpath(name)
    if clean.startswith(("/", "..")) or clean == ".":
        raise ValueError(f"no name for a file in a folder: {name!r}")
    return clean


class FilesWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root
        self.pending = f"_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        files, root = opened(self.root)
        held = []
        for row in iterator:
            name, draft = inside(row["file"]), f"{self.pending}/{uuid.uuid4().hex}"
            files.create_dir(f"{root}/{self.pending}", recursive=True)
            with files.open_output_stream(f"{root}/{draft}") as out:
                out.write(row["content"] or b"")
            held.append((draft, name))
        return Written(held)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.root)
        for draft, name in (pair for m in messages if m is not None for pair in m.files):
            files.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
            files.move(f"{root}/{draft}", f"{root}/{name}")
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.root))

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.pending}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.pending}")


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def store(files: DataFrame, folder: str) -> None:
    """Write rows (file, content) under a folder that all executors reach."""
    files.sparkSession.dataSource.register(FilesSource)
    files.select("file", "content").write.format(FORMAT).mode("append").save(folder)
