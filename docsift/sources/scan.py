"""File scan as a data source: every file is opened on its own, so that none can end the scan.

``binaryFile`` (see :func:`docsift.sources.files.scan_files`) ends the job at a file that cannot be opened, or leaves it out
without a word, and passes over empty files. Here such a file is a row with ``status`` ``failed``, and files that the exclusions leave out are rows with
``status`` ``skipped``, so that nothing goes uncounted. Paths are those of ``pyarrow.fs``: local folders and the object
stores and HDFS that it knows; the folder must be one that driver and executors reach.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docsift.sources.files import SKIPPED_SUFFIXES, excluded_names

SCHEMA = (
    "path string, size_bytes bigint, modified_time timestamp, created_time timestamp, content binary, status string, error string"
)
PARTITION_BYTES = 128 * 1024 * 1024
PARTITION_FILES = 10_000
BATCH_BYTES = 32 * 1024 * 1024
LONGEST = 2**31 - 1  # bytes that fit one value
_ARROW = pa.schema(
    [("path", pa.string()), ("size_bytes", pa.int64()), ("modified_time", pa.timestamp("us", "UTC")),
     ("created_time", pa.timestamp("us", "UTC")), ("content", pa.binary()), ("status", pa.string()), ("error", pa.string())]
)


class _Files(InputPartition):
    """Files that one task reads: path, size, time in microseconds, and the reason to leave the bytes alone."""

    def __init__(self, files: list[tuple[str, int, int, str | None]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        excludes = options.get("excludes")
        self.excludes = None if excludes is None else frozenset(json.loads(excludes))
        self.longest = int(options.get("longest", LONGEST))
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def _left_out(self, below: str) -> str | None:
        if self.excludes is None:
            return None
        if self.excludes.intersection(below.split("/")[:-1]):
            return "excluded folder"
        return "skipped suffix" if below.endswith(SKIPPED_SUFFIXES) else None

    def _listed(self) -> Iterator[tuple[str, int, int, str | None]]:
        """All files below the root, with or without the right to look into every folder."""
        fs, root = pafs.FileSystem.from_uri(self.root)
        folders = [root]
        while folders:
            folder = folders.pop()
            try:
                infos = fs.get_file_info(pafs.FileSelector(folder))
            except OSError as error:
                if folder == root:
                    raise
                yield folder, 0, 0, f"failed: {type(error).__name__}"
                continue
            for info in infos:
                if info.type == pafs.FileType.Directory:
                    folders.append(info.path)
                elif info.type == pafs.FileType.File:
                    yield info.path, info.size, (info.mtime_ns or 0) // 1000, self._left_out(info.path[len(root) :].lstrip("/"))

    def partitions(self) -> list[InputPartition]:
        """Files in the order of the listing, cut by bytes and by number."""
        cut: list[InputPartition] = []
        files: list[tuple[str, int, int, str | None]] = []
        held = 0
        for file in self._listed():
            weight = 0 if file[3] else file[1]
            if files and (held + weight > self.partition_bytes or len(files) >= PARTITION_FILES):
                cut.append(_Files(files))
                files, held = [], 0
            files.append(file)
            held += weight
        return [*cut, _Files(files)]

    def _row(self, fs: pafs.FileSystem, path: str, size: int, time: int, left_out: str | None) -> tuple:
        content, status, error = None, "read", None
        if left_out:
            status, error = ("failed", left_out[8:]) if left_out.startswith("failed: ") else ("skipped", left_out)
        elif size > self.longest:
            status, error = "failed", "longer than one value"
        else:
            try:
                with fs.open_input_stream(path) as stream:
                    content = stream.read()
                if len(content) > self.longest:
                    content, status, error = None, "failed", "longer than one value"
            except OSError as problem:
                status, error = "failed", type(problem).__name__
        return path, size, time, time, content, status, error

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.root)
        rows, held = [], 0
        for file in partition.files:
            rows.append(self._row(fs, *file))
            held += len(rows[-1][4] or b"") + 100
            if held > BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class FileScan(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docsift_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan_each_file(spark: SparkSession, root: str, exclude_dirs: Iterable[str] | None = None, longest: int = LONGEST) -> DataFrame:
    """One row per file below ``root``, with ``status`` (``read``, ``skipped``, ``failed``) and ``error`` besides the columns
    of :func:`docsift.sources.files.scan_files`.

    Only files with status ``read`` have bytes. A file that vanished or lost its read permission after the listing, or is longer
    than ``longest`` bytes, is ``failed``; so is a folder that cannot be listed. With ``exclude_dirs`` (possibly empty) the default
    and the given folder names and the skipped suffixes are ``skipped`` and never opened.
    """
    spark.dataSource.register(FileScan)
    reader = spark.read.format(FileScan.name()).option("path", root).option("longest", longest)
    if exclude_dirs is not None:
        reader = reader.option("excludes", json.dumps(excluded_names(exclude_dirs)))
    return reader.load()
