"""Source trees as a data source: ``spark.read.format("source_tree").load(folder)``.

A row a file of every repository (folder) below the path. Planning lists names only and cuts
them into ranges of a folder's names, so a huge folder is read by many tasks and small ones
share a task. Conditions on repo_id and on starts and ends of path keep folders from being
listed and files from being read; they need ``spark.sql.python.filterPushdown.enabled``.

The planning runs on the driver and keeps one range for ``FILES_PER_TASK`` files. For
fleets whose names don't fit there, ``tree.scan_fleet`` lists in distributed steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith

FILES_PER_TASK = 256
#: Rows and bytes of a batch handed to Spark.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20

SCHEMA = "repo_id string, path string, ext string, n_bytes long, content string, readable boolean"
_ARROW = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("ext", pa.string()), ("n_bytes", pa.int64()), ("content", pa.string()), ("readable", pa.bool_())])


@dataclass
class Ranges(InputPartition):
    """(folder below the root, first name, last name) of the files of one task."""

    folders: list[tuple[str, str, str]]


def suffix(name: str) -> str:
    """Last suffix of a file name; a leading dot does not start one."""
    stem, dot, end = name.rpartition(".")
    return dot + end if stem.strip(".") else ""


class TreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.repos: list[set[str]] = []
        self.starts: list[str] = []
        self.ends: list[str] = []
        self.paths: list[set[str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case EqualTo(("repo_id",), str(value)):
                    self.repos.append({value})
                case In(("repo_id",), values):
                    self.repos.append(set(values))
                case EqualTo(("path",), str(value)):
                    self.paths.append({value})
                case In(("path",), values):
                    self.paths.append(set(values))
                case StringStartsWith(("path",), value):
                    self.starts.append(value)
                case StringEndsWith(("path",), value):
                    self.ends.append(value)
                case IsNotNull(("repo_id",)) | IsNotNull(("path",)):
                    pass  # they never are
                case _:
                    yield f

    def _may_hold(self, folder: str) -> bool:
        """Whether files below a folder (repository first) can fit."""
        repo, _, path = folder.partition("/")
        inner = f"{path}/" if path else ""
        return (
            all(repo in r for r in self.repos)
            and all(inner.startswith(s) or s.startswith(inner) for s in self.starts)
            and all(any(p.startswith(inner) for p in ps) for ps in self.paths)
        )

    def _fits(self, path: str) -> bool:
        return all(path.startswith(s) for s in self.starts) and all(path.endswith(e) for e in self.ends) and all(path in p for p in self.paths)

    def _files(self, folder: str) -> tuple[list, list[str]]:
        """Fitting files of a folder by name, and the folders inside it that may hold some."""
        fs, top = pafs.FileSystem.from_uri(self.root)
        found = fs.get_file_info(pafs.FileSelector(f"{top}/{folder}".rstrip("/"), recursive=False))
        inner = [f"{folder}/{e.base_name}".lstrip("/") for e in found if e.type == pafs.FileType.Directory]
        path = folder.partition("/")[2]
        files = [e for e in found if e.type == pafs.FileType.File and folder and self._fits(f"{path}/{e.base_name}".lstrip("/"))]
        return sorted(files, key=lambda e: e.base_name), [f for f in inner if self._may_hold(f)]

    def partitions(self) -> list[Ranges]:
        out, open_ranges, size = [], [], 0
        pending = [""]
        while pending:
            folder = pending.pop()
            files, inner = self._files(folder)
            pending += inner
            at = 0
            while at < len(files):
                take = min(len(files) - at, FILES_PER_TASK - size)
                open_ranges.append((folder, files[at].base_name, files[at + take - 1].base_name))
                at, size = at + take, size + take
                if size == FILES_PER_TASK:
                    out.append(Ranges(open_ranges))
                    open_ranges, size = [], 0
        return out + ([Ranges(open_ranges)] if open_ranges else [])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Ranges):  # nothing was planned
            return
        fs, _ = pafs.FileSystem.from_uri(self.root)
        rows, held = [], 0
        for folder, first, last in partition.folders:
            repo, _, inner = folder.partition("/")
            for entry in self._files(folder)[0]:
                if not first <= entry.base_name <= last:
                    continue
                with fs.open_input_stream(entry.path, compression=None) as stream:
                    data = stream.read()
                try:
                    text = data.decode()
                except UnicodeDecodeError:
                    text = None
                path = f"{inner}/{entry.base_name}".lstrip("/")
                rows.append((repo, path, suffix(entry.base_name), len(data), text, text is not None))
                held += len(data)
                if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
