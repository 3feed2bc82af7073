"""A sink that writes a file for each row: a data source with stages, so that a task that fails or runs twice leaves nothing behind."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    stage: str
    names: tuple[str, ...]


class FileWriter(DataSourceWriter):
    """Tasks write into folders of their own below _stage; commit() moves the files of the tasks that count, abort() leaves none."""

    def __init__(self, path: str, suffix: str, mark: str, overwrite: bool):
        import uuid

        self.path, self.suffix, self.mark, self.overwrite = path, suffix, mark, overwrite
        self.job = f"_stage-{uuid.uuid4().hex}"

    def _store(self):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return store, root.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        import uuid

        store, root = self._store()
        stage, names = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(stage, recursive=True)
        for name, text in iterator:
            if not name or re.search(r"[/\\\x00]|^\.+$", name):
                raise ValueError(f"no name for a file: {name!r}")
            file = f"{name}{self.suffix}"
            if file in names[-1:]:
                raise ValueError(f"two rows are called {name!r}")
            with store.open_output_stream(f"{stage}/{file}") as out:
                out.write((self.mark + (text or "")).encode())
            names.append(file)
        return Written(stage, tuple(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, root = self._store()
        found = [m for m in messages if m is not None]
        every = [n for m in found for n in m.names]
        if len(set(every)) < len(every):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.type == fs.FileType.File and old.base_name.endswith(self.suffix):
                    store.delete_file(old.path)
        for m in found:
            for n in m.names:
                store.move(f"{m.stage}/{n}", f"{root}/{n}")
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        place = posixpath.join(root, self.job)
        if store.get_file_info(place).type == fs.FileType.Directory:
            store.delete_dir(place)


class TextFiles(DataSource):
    """Format `textloom_files`: rows (name, text) become files. Options: path (of a folder that all executors see), suffix, mark (before each text)."""

    @classmethod
    def name(cls) -> str:
        return "textloom_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], self.options.get("suffix", ".txt"), self.options.get("mark", ""), overwrite)


def write_files(df: DataFrame, path: str, name: str, text: str = "text", suffix: str = ".md", mark: str = "﻿", mode: str = "append") -> None:
    """A file for each row, called by a column, with a byte order mark before the text. Names must differ. mode: append or overwrite.

    commit() moves files one by one on the driver: their number is that of the rows, so this is for reports, not for a corpus.
    """
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(TextFiles)
    df.selectExpr(f"cast(`{name}` as string) as name", f"cast(`{text}` as string) as text").write.format("textloom_files").mode(mode).option("suffix", suffix).option("mark", mark).save(path)


def write_json_files(df: DataFrame, path: str, name: str, mode: str = "append") -> None:
    """A JSON file for each row, called by a column: all columns of the row as one readable object."""
    from pyspark.sql import functions as F

    write_files(df.select(F.col(name), F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"pretty": "true"}).alias("text")), path, name, suffix=".json", mark="", mode=mode)
