"""Library folders as a Spark data source: ``spark.read.format("library")`` and ``spark.readStream.format("library")``.

Rows are (path, name, kind, reader, size, modified, content, flag): texts as text, media as empty texts with a flag
that a provider is to fill, other files without content. Options: ``path``; ``kinds``, a comma list of extensions;
``unknown`` = error (default) or skip, for files of a type that the library doesn't know; ``task_bytes``, how much
one task reads. Filters on kind and reader are pushed to the listing: files of other kinds are not opened. A stream's
offset is the modification time and name of the last file; files come in that order, ``batch_files`` at a time.

The folder is one that the driver and all executors see. Listing is the driver's work, reading that of the tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from cairnspark.sources.loaders import READERS, SUPPORTED, unsupported

SCHEMA = "path string, name string, kind string, reader string, size long, modified long, content string, flag boolean"
READER_OF = {kind: name for name, kinds in READERS.items() for kind in kinds}


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


def kind_of(path: str) -> str:
    return os.path.splitext(path)[1].lower().strip(".")


def listed(options: dict) -> list[tuple[str, int, int]]:
    """(path, size, modified in microseconds) of the folder's files, by modification and name."""
    wanted = {k.strip().lower() for k in options.get("kinds", "").split(",") if k.strip()}
    out = []
    for folder, _, names in os.walk(options["path"].removeprefix("file://")):
        for name in names:
            kind = kind_of(name)
            if wanted and kind not in wanted or name.startswith((".", "_")):
                continue
            if kind not in SUPPORTED:
                if options.get("unknown", "error") == "error":
                    raise ValueError(unsupported(kind))
                continue
            s = os.stat(os.path.join(folder, name))
            out.append((os.path.join(folder, name), s.st_size, s.st_mtime_ns // 1000))
    return sorted(out, key=lambda f: (f[2], f[0]))


def dealt(files: list[tuple[str, int, int]], task_bytes: int) -> list[Files]:
    """Runs of files of about so many bytes together; a file costs some bytes by itself."""
    parts: list[Files] = []
    held: list[tuple[str, int, int]] = []
    size = 0
    for f in files:
        if held and size + f[1] > task_bytes:
            parts.append(Files(held))
            held, size = [], 0
        held.append(f)
        size += f[1] + 4096
    return [*parts, Files(held)] if held else parts


def rows(files: list[tuple[str, int, int]]) -> Iterator[tuple]:
    for path, size, modified in files:
        kind = kind_of(path)
        reader = READER_OF[kind]
        content = None
        if reader == "text" or kind == "csv":
            with open(path, "rb") as f:
                content = f.read().decode("utf-8", "ignore")
        media = reader in ("image", "audio")
        yield path, os.path.basename(path), kind, reader, size, modified, "" if media else content, media


class LibraryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.kinds = options, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute if isinstance(f, (EqualTo, In)) else ()
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else set()
            if name == ("kind",):
                kinds = values
            elif name == ("reader",):
                kinds = {k for k, r in READER_OF.items() if r in values}
            else:
                yield f
                continue
            self.kinds = kinds if self.kinds is None else self.kinds & kinds

    def partitions(self) -> list[Files]:
        files = [f for f in listed(self.options) if self.kinds is None or kind_of(f[0]) in self.kinds]
        return dealt(files, int(self.options.get("task_bytes", 64 << 20))) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(partition.files)


class LibraryStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.at = {"modified": -1, "path": ""}

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def _after(self, offset: dict) -> list[tuple[str, int, int]]:
        return [f for f in listed(self.options) if (f[2], f[0]) > (offset["modified"], offset["path"])]

    def latestOffset(self) -> dict:
        new = self._after(self.at)[: int(self.options.get("batch_files", 1000))]
        if new:
            self.at = {"modified": new[-1][2], "path": new[-1][0]}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.at = max((self.at, end), key=lambda o: (o["modified"], o["path"]))
        files = [f for f in self._after(start) if (f[2], f[0]) <= (end["modified"], end["path"])]
        return dealt(files, int(self.options.get("task_bytes", 64 << 20)))

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(partition.files)

    def commit(self, end: dict) -> None:
        pass


class LibrarySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LibraryReader:
        return LibraryReader(dict(self.options))

    def streamReader(self, schema) -> LibraryStream:
        return LibraryStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its pushed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LibrarySource)
