"""Binary profile files.

Record: u32 id length with NUL, id, NUL, u32 n, ceil(n/2) bytes of two 4-bit
bases, n doubles; all little endian. Footer: u64 count, u16 version, marker.
Records have no sync marks, so one light pass hops over the record heads of each
file and cuts it into splits; many tasks then decode the splits.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from profseek.functions.shared import file_uri, filesystem, fresh_path, spread_rows
from profseek.operators.tiles import Sizes

# fixed values of the format
MARKER = b"[eofdb]"
VERSION = 1
FOOTER = 8 + 2 + len(MARKER)
LETTERS = "ACGTN"

SPLIT_BYTES = 64 << 20
BATCH_CELLS = 1 << 19
HEAD_BYTES = 16 << 10


def _body_end(stream, size: int) -> int:
    if size < FOOTER:
        raise ValueError("file too short for a footer")
    stream.seek(size - FOOTER)
    if stream.read(FOOTER)[-len(MARKER):] != MARKER:
        raise ValueError("invalid end of file marker")
    return size - FOOTER


def _head(stream, at: int) -> tuple[str, int, int]:
    """(id, length, offset of the bases) of the record at an offset."""
    stream.seek(at)
    raw = stream.read(4)
    if len(raw) < 4:
        raise ValueError("cannot read sequence id length")
    size = struct.unpack("<I", raw)[0]
    name = stream.read(size)
    if len(name) < size or not name.endswith(b"\0"):
        raise ValueError("sequence id is not NUL terminated")
    raw = stream.read(4)
    if len(raw) < 4:
        raise ValueError("cannot read sequence length")
    return name[:-1].decode(), struct.unpack("<I", raw)[0], at + 8 + size


def split_points(stream, size: int, split_bytes: int):
    """(start, end, number of the first record, records, positions, longest record) of record runs."""
    end, at, first, number, opened, cells, longest = _body_end(stream, size), 0, 0, 0, 0, 0, 0
    heads = io.BufferedReader(stream, HEAD_BYTES)  # short records: many heads with one read
    while at < end:
        _, n, body = _head(heads, at)
        at = body + (n + 1) // 2 + 8 * n
        if at > end:
            raise ValueError("record runs past the end of file marker")
        number, cells, longest = number + 1, cells + n, max(longest, n)
        if at - opened >= split_bytes or at == end:
            yield opened, at, first, number - first, cells, longest
            opened, first, cells, longest = at, number, 0, 0
    heads.detach()  # the stream stays the caller's


def decode_bases(packed: bytes, n: int) -> str:
    pairs = np.frombuffer(packed, dtype=np.uint8)
    codes = np.stack([pairs >> 4, pairs & 15], axis=1).ravel()
    if (codes >= len(LETTERS)).any():
        raise ValueError("encoded nibble is not a valid base")
    return np.frombuffer(LETTERS.encode(), dtype=np.uint8)[codes[:n]].tobytes().decode()


def _decode(stream, start: int, end: int, number: int):
    at = start
    while at < end:
        name, n, body = _head(stream, at)
        packed = stream.read((n + 1) // 2)
        values = stream.read(8 * n)
        if len(values) < 8 * n:
            raise ValueError("unexpected end of file")
        narrow = np.frombuffer(values, dtype="<f8").astype(np.float32)  # single precision in the engine
        yield name, number, decode_bases(packed, n), narrow
        at, number = body + (n + 1) // 2 + 8 * n, number + 1


def _batch(rows) -> pa.RecordBatch:
    names, numbers, bases, values = zip(*rows)
    flat = np.concatenate(values) if values else np.array([], np.float32)
    missing = np.isnan(flat) | (flat == -999.0)
    bounds = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    return pa.RecordBatch.from_pydict({
        "id": pa.array(names), "ord": pa.array(numbers, pa.int64()), "bases": pa.array(bases),
        "reactivity": pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.float64), mask=missing)),
        "molecule": pa.array(["DNA"] * len(names))})


def decoded_batches(stream, start: int, end: int, number: int):
    """Batches of bounded size of the records between two offsets."""
    held, cells = [], 0
    for record in _decode(stream, start, end, number):
        held.append(record)
        cells += len(record[3])
        if cells >= BATCH_CELLS:
            yield _batch(held)
            held, cells = [], 0
    if held:
        yield _batch(held)


def record_runs(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Splits of all files, found from the record heads only."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][bB]").load(path)
             .select("path", "length"))
    names = ["start", "end", "first", "records", "cells", "longest"]

    def index(frames):
        for frame in frames:
            for name, size in zip(frame["path"], frame["length"]):
                fs, inner = filesystem(name)
                with fs.open_input_file(inner) as stream:
                    points = list(split_points(stream, int(size), split_bytes))
                if points:
                    yield pd.DataFrame(points, columns=names).assign(path=name)

    return files.mapInPandas(index, ", ".join(f"{n} long" for n in names) + ", path string")


def native_sizes(spark: SparkSession, path: str) -> Sizes:
    """Database sizes without decoding it."""
    row = record_runs(spark, path).agg(F.sum("records").alias("p"), F.sum("cells").alias("c"),
                                       F.max("longest").alias("m")).first()
    return Sizes(int(row["p"] or 0), int(row["c"] or 0), int(row["m"] or 0))


def read_native(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Profiles of one .db file or of a folder of them."""
    # one row per split; records are numbered over all files
    earlier = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = record_runs(spark, path, split_bytes).select(
        "path", "start", "end", F.coalesce(F.sum("records").over(earlier), F.lit(0)).cast("long").alias("first"))

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, inner = filesystem(row["path"])
                with fs.open_input_file(inner) as stream:
                    yield from decoded_batches(stream, row["start"], row["end"], row["first"])

    return spread_rows(splits, "path", "start", wide=True).mapInArrow(
        decode, "id string, ord long, bases string, reactivity array<double>, molecule string")


def encode_record(name: str, bases: str, cells: np.ndarray) -> bytes:
    """One record; `cells` are little-endian doubles with the sentinel for missing values."""
    raw = name.encode() + b"\0"
    n = len(bases)
    code = np.zeros(256, dtype=np.uint8)
    code[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    codes = np.zeros(n + n % 2, dtype=np.uint8)
    codes[:n] = code[np.frombuffer(bases.encode(), dtype=np.uint8)]
    packed = (codes[0::2] << 4 | codes[1::2]).tobytes()
    return struct.pack("<I", len(raw)) + raw + struct.pack("<I", n) + packed + cells.astype("<f8").tobytes()


def footer(count: int) -> bytes:
    return struct.pack("<QH", count, VERSION) + MARKER


def encode_batch(batch: pa.RecordBatch, out) -> None:
    """Append the records of a batch with id, bases and reactivity to a stream."""
    lists = batch.column("reactivity")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.where(np.isnan(flat), -999.0, flat)
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    names, bases = batch.column("id").to_pylist(), batch.column("bases").to_pylist()
    for name, letters, a, b in zip(names, bases, bounds[:-1], bounds[1:]):
        out.write(encode_record(name, letters, flat[a:b]))


def write_native(profiles: DataFrame, path: str) -> int:
    """Write a folder of part-N.db files, each complete in itself; returns the number of records."""
    target = file_uri(path)

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        fs, inner = filesystem(target)
        fs.create_dir(inner, recursive=True)
        draft, count = f"{inner}/.part-{part:05d}-{attempt}", 0
        with fs.open_output_stream(draft) as out:
            for batch in batches:
                encode_batch(batch, out)
                count += batch.num_rows
            out.write(footer(count))
        if count:
            fs.move(draft, f"{inner}/part-{part:05d}.db")
        else:
            fs.delete_file(draft)
        yield pa.RecordBatch.from_pydict({"n": pa.array([count], pa.int64())})

    done = profiles.select("id", "bases", "reactivity").mapInArrow(write, "n long")
    return int(done.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])


def write_native_file(profiles: DataFrame, path: str) -> int:
    """One .db file for other readers: parts first, then one task streams them together."""
    spark = profiles.sparkSession
    parts = fresh_path(spark, "native-parts")
    ordered = profiles.orderBy("ord", "id")
    count = write_native(ordered, parts)
    target = file_uri(path)

    def join(frames):
        for _ in frames:
            from pyarrow.fs import FileSelector

            fs, folder = filesystem(parts)
            out_fs, inner = filesystem(target)
            found = sorted(f.path for f in fs.get_file_info(FileSelector(folder)) if f.path.endswith(".db"))
            with out_fs.open_output_stream(inner) as out:
                for name in found:
                    left = fs.get_file_info(name).size - FOOTER
                    with fs.open_input_stream(name) as part:
                        while left > 0:
                            piece = part.read(min(left, 8 << 20))
                            out.write(piece)
                            left -= len(piece)
                out.write(footer(count))
            yield pd.DataFrame({"n": [count]})

    spark.range(1).coalesce(1).mapInPandas(join, "n long").count()
    return count
