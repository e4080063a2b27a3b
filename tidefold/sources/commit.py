"""Whole files written by tasks with a commit: files of failed or doubled attempts are never seen.

A task writes its files to a folder of its attempt below `_staging`, which readers of folders pass over, and says what it wrote.
When all tasks are done the driver moves the files of one attempt of each to their names, by renames alone, several at a
time; after a failure it deletes what was staged.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .storage import locate

#: Renames that the driver has under way at once.
RENAMES = 32


@dataclass
class Written(WriterCommitMessage):
    """What an attempt wrote: its folder and the names of its files."""

    attempt: str
    names: list[str]


class WholeFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator) -> Written:
        attempt, found = uuid.uuid4().hex, []
        system, at = locate(f"{self.path}/_staging/{self.job}/{attempt}")
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                to = f"{at}/{name}"
                system.create_dir(to.rpartition("/")[0], recursive=True)
                with system.open_output_stream(to) as out:
                    out.write(content.as_buffer())
                found.append(name)
        return Written(attempt, found)

    def commit(self, messages) -> None:
        system, at = locate(self.path)
        system.create_dir(at, recursive=True)
        moves = [(f"{at}/_staging/{self.job}/{m.attempt}/{n}", f"{at}/{n}") for m in messages if m is not None for n in m.names]
        for folder in {to.rpartition("/")[0] for _, to in moves}:
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(lambda m: system.move(*m), moves))
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, at = locate(f"{self.path}/_staging")
        if system.get_file_info(f"{at}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.job}")
        if system.get_file_info(at).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(at)):
            system.delete_dir(at)


class WholeFiles(DataSource):
    """df.write.format("whole_files").mode("append").save(path): a file for each row of (name, content)."""

    @classmethod
    def name(cls):
        return "whole_files"

    def schema(self):
        return "name string, content binary"

    def writer(self, schema, overwrite):
        return WholeFilesWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """A file for each row of (name, content), below `path`; a name may have folders. Files of the same name are replaced.

    Nothing is to be seen before all are written, and nothing stays of a write that fails. No rows write no file.
    """
    files.sparkSession.dataSource.register(WholeFiles)
    files.select("name", "content").write.format("whole_files").mode("append").save(path)


def files_of(rows: DataFrame, make, by: list) -> DataFrame:
    """Files from rows in order: `make` goes over a partition's rows, sorted by `by`, and yields (name, content)."""

    def run(batches) -> Iterator:
        import pandas as pd

        for name, content in make(row for pdf in batches for row in pdf.itertuples(index=False, name=None)):
            yield pd.DataFrame({"name": [name], "content": [content]})

    return (rows.sortWithinPartitions(*by) if by else rows).mapInPandas(run, "name string, content binary")
