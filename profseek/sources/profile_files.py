"""Binary profile files as a Spark data source: spark.read.format("profiles"), df.write.format("profiles").

Reading plans splits from the record heads of files over `splitBytes` and from
the footers alone of the others (splits of less than 64 MB grow with the files, so that there are
about 1024 at most and one more a file), and numbers records over all files of a folder
in the order of their names. Writing gives part files to a folder; they are
drafts, which readers do not see, until every task is done. A failed write
deletes its drafts and leaves the files of earlier writes as they were, also
with mode "overwrite". Renaming is one file at a time, so a driver lost in the
middle of it leaves whole files, perhaps beside earlier ones. Rows with a null id, bases or values fail the write.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from profseek.functions.shared import filesystem, ship_package
from profseek.sources.native import (FOOTER, SPLIT_BYTES, _body_end, decoded_batches, encode_batch, footer, split_points)

MAX_SPLITS = 1024  # above it splits grow, up to SPLIT_BYTES: a task must be worth its start
SCHEMA = "id string, ord long, bases string, reactivity array<double>, molecule string"


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    #: Number of the first record over all files.
    first: int


@dataclass
class Draft(WriterCommitMessage):
    path: str
    records: int


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the .db files of a folder by name, or of one file."""
    from pyarrow.fs import FileSelector, FileType

    fs, inner = filesystem(path)
    info = fs.get_file_info(inner)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(FileSelector(inner)) if info.type == FileType.Directory else [info]
    names = [(f.path, f.size) for f in found if f.type == FileType.File]
    return sorted((name, size) for name, size in names if info.type == FileType.File or (
        name.lower().endswith(".db") and not name.rsplit("/", 1)[-1].startswith((".", "_"))))


class _Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Split]:
        fs, _ = filesystem(self.path)
        splits, number, files = [], 0, _files(self.path)
        split_bytes = max(self.split_bytes, min(SPLIT_BYTES, sum(size for _, size in files) // MAX_SPLITS))
        for name, size in files:
            with fs.open_input_file(name) as stream:
                end = _body_end(stream, size)
                stream.seek(end)
                count = struct.unpack("<Q", stream.read(FOOTER)[:8])[0]
                if size <= split_bytes:
                    splits += [Split(name, 0, end, number)] if end else []
                    number += count
                    continue
                for start, stop, first, records, _, _ in split_points(stream, size, split_bytes):
                    splits.append(Split(name, start, stop, number + first))
                number += first + records
        return splits

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file holds a record
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.path) as stream:
            yield from decoded_batches(stream, partition.start, partition.end, partition.first)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def _drafts(self) -> str:
        return f"{filesystem(self.path)[1]}/_drafts-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Draft:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, _ = filesystem(self.path)
        fs.create_dir(self._drafts(), recursive=True)
        draft, count = f"{self._drafts()}/part-{context.partitionId():05d}-{context.taskAttemptId()}", 0
        with fs.open_output_stream(draft) as out:
            for batch in iterator:
                if any(batch.column(c).null_count for c in ("id", "bases", "reactivity")):
                    raise ValueError("a profile without id, bases or values cannot be written")
                encode_batch(batch, out)
                count += batch.num_rows
            out.write(footer(count))
        return Draft(draft, count)

    def commit(self, messages: list[Draft | None]) -> None:
        """Earlier files go and drafts are renamed; drafts of attempts that lost are not named here and go too."""
        fs, inner = filesystem(self.path)
        fs.create_dir(inner, recursive=True)
        earlier = [name for name, _ in _files(self.path)] if self.overwrite else []
        for n, message in enumerate(m for m in messages if m is not None and m.records):
            fs.move(message.path, f"{inner}/part-{self.run}-{n:05d}.db")
        for name in earlier:
            fs.delete_file(name)
        self._clear(fs)

    def abort(self, messages: list[Draft | None]) -> None:
        self._clear(filesystem(self.path)[0])

    def _clear(self, fs) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(self._drafts()).type == FileType.Directory:
            fs.delete_dir(self._drafts())


class ProfileFiles(DataSource):
    """Options: path, and splitBytes for reading."""

    @classmethod
    def name(cls) -> str:
        return "profiles"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("profiles are read from and written to a path")
        return path

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self._path(), int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        missing = {"id", "bases", "reactivity"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"profiles lack the columns {sorted(missing)}")
        return _Writer(self._path(), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship_package(spark)
    spark.dataSource.register(ProfileFiles)
