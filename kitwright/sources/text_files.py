"""A sink with a text file for each row, named by it: ``df.write.format("text_files").save(folder)``.

Rows have ``file_name`` (a relative path) and ``body``. A task writes to a
folder of its own beside ``path``; when all have succeeded the driver moves each
task's folder into place (one move a task, not a file) and the whole to
``path``. Folders of tasks that failed or ran twice are not moved, and if the
job fails everything is deleted. Files go to ``path/part-<task>/<file_name>``.
Rows of one name within a task are an error, as are names that lead out of it.
An existing ``path`` is an error, too, unless the mode is ``overwrite``.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file_name string, body string"


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task that has succeeded, and its number."""

    folder: str
    task: int


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TextFilesWriter(self.options["path"], overwrite)


class TextFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}.staging-{uuid.uuid4()}"
        files, staging = fs.FileSystem.from_uri(self.staging)
        files.create_dir(staging, recursive=True)

    def write(self, iterator: Iterator[Row]) -> Written:
        files, staging = fs.FileSystem.from_uri(self.staging)
        folder, task = f"{staging}/attempt-{uuid.uuid4()}", TaskContext.get().partitionId()
        # Not recursive: a task that still runs when its job has failed does not make the deleted folder anew.
        files.create_dir(folder, recursive=False)
        seen, folders = set(), {""}
        for row in iterator:
            name = posixpath.normpath(row["file_name"])
            if name in seen or name.startswith(("/", "..")):
                raise ValueError(f"not a name for a file of its own: {row['file_name']}")
            seen.add(name)
            parts = posixpath.dirname(name).split("/")
            for above in ("/".join(parts[: k + 1]) for k in range(len(parts))):
                if above not in folders:
                    files.create_dir(f"{folder}/{above}", recursive=False)
                    folders.add(above)
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write((row["body"] or "").encode("utf-8"))
        return Written(folder, task)

    def commit(self, messages: list[Written | None]) -> None:
        files, staging = fs.FileSystem.from_uri(self.staging)
        place = fs.FileSystem.from_uri(self.path)[1]
        there = files.get_file_info(place).type != fs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        files.create_dir(f"{staging}/done", recursive=False)
        for m in messages:
            if m is not None:
                files.move(m.folder, f"{staging}/done/part-{m.task:05d}")
        if there:
            files.delete_dir(place)
        files.move(f"{staging}/done", place)
        self.abort(messages)  # what is left: folders of tasks that failed

    def abort(self, messages: list[Written | None]) -> None:
        files, staging = fs.FileSystem.from_uri(self.staging)
        if files.get_file_info(staging).type != fs.FileType.NotFound:
            files.delete_dir(staging)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(TextFiles)
