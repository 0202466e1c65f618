"""A folder of text files as a Spark data source: spark.read, spark.readStream and df.write with format("textora").

Register it with spark.dataSource.register(FolderSource). Reading gives a row for every file that is not hidden, with its
text or the reason why there is none: one broken file never fails a read. Files are dealt to tasks by size. As a stream,
each batch holds the files that have come since, in order of time and name. Writing puts a file for each row under a name
of its task, which the commit moves to its final name; an abort, or a task that fails, leaves nothing behind. Options:
path (any store that pyarrow knows, or a local folder), bytes (of files a task reads), glob.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from textora.sources.decoding import kept_name, read_text

SCHEMA = "path string, bytes long, modified timestamp, format string, text string, skipped string, detail string"
#: Bytes of files that a task reads unless told otherwise.
TASK_BYTES = 64 << 20


def _opened(path: str) -> tuple:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _listed(options: dict) -> list[tuple]:
    """(modified in ns, path below the folder, bytes) of the files to read, in order."""
    fs, base = _opened(options["path"])
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
    rows = [(int(f.mtime_ns or 0), f.path[len(base) :].lstrip("/"), f.size or 0) for f in found if f.type == pafs.FileType.File]
    return sorted(r for r in rows if kept_name(r[1]) and fnmatch.fnmatch(r[1].rsplit("/", 1)[-1], options.get("glob", "*")))


@dataclass
class Files(InputPartition):
    files: list[tuple]


def _dealt(files: list[tuple], most: int) -> list[Files]:
    out, size = [Files([])], 0
    for f in files:
        if out[-1].files and size + f[2] > most:
            out.append(Files([]))
            size = 0
        out[-1].files.append(f)
        size += f[2]
    return out


def _rows(options: dict, files: list[tuple]) -> Iterator[tuple]:
    from datetime import datetime, timezone

    fs, base = _opened(options["path"])
    for when, path, size in files:
        try:
            with fs.open_input_stream(f"{base}/{path}", compression=None) as f:
                row = read_text(f.read(), path)
        except OSError as e:
            row = {"format": None, "text": None, "skipped": "unreadable", "detail": str(e)[:200]}
        yield path, size, datetime.fromtimestamp(when / 1e9, timezone.utc), row["format"], row["text"], row["skipped"], row["detail"]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Files]:
        return _dealt(_listed(self.options), int(self.options.get("bytes", TASK_BYTES)))

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.options, partition.files)


class _StreamReader(DataSourceStreamReader):
    """An offset is the time and name of the last file read; a later file has a greater one."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"modified": "-1", "path": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.options)
        return {"modified": str(files[-1][0]), "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        first, last = ((int(o["modified"]), o["path"]) for o in (start, end))
        return _dealt([f for f in _listed(self.options) if first < f[:2] <= last], int(self.options.get("bytes", TASK_BYTES)))

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.options, partition.files)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    """(temporary, final) names of a task's files."""

    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Rows need path and text; null text is an empty file, a path's parts that lead out of the folder are dropped, and
    rows that repeat a path leave one of them."""

    def __init__(self, options: dict, schema, overwrite: bool) -> None:
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex
        if missing := {"path", "text"} - {f.name for f in schema}:
            raise ValueError(f"rows to write lack {', '.join(sorted(missing))}")

    def write(self, iterator) -> Written:
        fs, base = _opened(self.options["path"])
        mine, done = f"{base}/_temporary-{self.job}/{uuid.uuid4().hex}", []
        for n, row in enumerate(iterator):
            name = "/".join(p for p in (row["path"] or "").split("/") if p not in ("", ".", ".."))
            if not name:
                raise ValueError("a row to write has no path")
            if n == 0:
                fs.create_dir(mine, recursive=True)
            with fs.open_output_stream(f"{mine}/{n}", compression=None) as out:
                out.write((row["text"] or "").encode())
            done.append((f"{mine}/{n}", name))
        return Written(done)

    def _ended(self) -> None:
        fs, base = _opened(self.options["path"])
        if fs.get_file_info(f"{base}/_temporary-{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/_temporary-{self.job}")

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _opened(self.options["path"])
        files = [f for m in messages if m for f in m.files]
        if self.overwrite:
            kept = {f"{base}/{name}" for _, name in files}
            for f in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
                if f.type == pafs.FileType.File and f.path not in kept and f"/_temporary-{self.job}/" not in f.path:
                    fs.delete_file(f.path)
        for temp, name in files:
            fs.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
            fs.move(temp, f"{base}/{name}")
        self._ended()

    def abort(self, messages: list[Written | None]) -> None:
        self._ended()


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textora"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), schema, overwrite)
