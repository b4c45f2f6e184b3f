"""Packing by patterns: few-document length patterns fitted to the histogram by non-negative least squares.

Documents become pieces of at most `limit` tokens. Only their histogram, `limit`
numbers at most, reaches the driver. There, patterns of two to four lengths that
fill a sequence exactly are enumerated, their repeat counts are fitted to the
histogram with weights that favour long pieces, rounded within what is there,
and the rest is packed best-fit, longest first, on counts. The outcome is a list
of runs: so many pieces of one length, at this place of those sequences. Pieces
are ranked among those of their length, in buckets, so a hot length is spread;
their rank then tells sequence and offset.

Null and empty texts are one piece, the end token. Long documents are cut into
whole pieces of `limit`, the last may be shorter. Repeated rows are packed each.
An empty table gives an empty result. Other columns are not carried.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profseek.functions.shared import fresh_path
from profseek.llm.rows import without_cycle_search
from profseek.llm.word_tokens import word_tokens

#: Enumerated patterns per longest length and number of documents.
PATTERNS_PER_LENGTH = 12
ROUNDS = 150
#: Pieces of one length per rank bucket, roughly.
BUCKET = 2048


def pieces(df: DataFrame, vocabulary: str, limit: int = 4096, end: int = 1, id_col: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document's tokens and the end token."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, tail, width = word_tokens(vocabulary), struct.pack("<I", end), 4 * limit
        for batch in without_cycle_search(batches):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                data = tokens.encode(value.as_py() or "") + tail
                for k in range(0, len(data), width):
                    part = data[k:k + width]
                    rows.append(row)
                    piece.append(k // width)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows, pa.int32())), *(
                pa.array(x, pa.int64()) for x in (piece, start, length, crc))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                columns, ["id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])

    narrow = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(cut, f"id {kind}, piece long, start long, length long, ids_crc32 long"
                             + ", ids array<int>" * with_ids)


def _patterns(present: np.ndarray, limit: int, most: int) -> list[tuple[int, ...]]:
    """Sets of two to four present lengths that sum to the limit; `most` for each longest one and size."""
    there = np.zeros(limit + 1, bool)
    there[present] = True
    found: set[tuple[int, ...]] = set()

    def spread(values: np.ndarray) -> np.ndarray:
        return values if len(values) <= most else values[np.linspace(0, len(values) - 1, most).astype(int)]

    for a in present[present < limit]:
        rest = limit - a
        if rest <= a and there[rest]:
            found.add((int(a), int(rest)))
        second = present[(present <= a) & (present < rest)]
        third = rest - second
        for b in spread(second[(third <= second) & there[third]]):
            found.add((int(a), int(b), int(rest - b)))
        for b in spread(second[3 * second >= rest]):
            third = present[(present <= b) & (present < rest - b)]
            fourth = rest - b - third
            fit = third[(fourth <= third) & there[fourth]]
            if len(fit):
                c = int(fit[(int(a) * 31 + int(b)) % len(fit)])
                found.add((int(a), int(b), c, int(rest - b - c)))
    return sorted(found, reverse=True)


def _fit(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram, longer lengths weighing more."""
    if not patterns:
        return np.zeros(0)
    owner = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    length = np.concatenate([np.asarray(p) for p in patterns])
    weight = np.arange(len(counts)) / (len(counts) - 1)
    target = np.bincount(owner, (weight * counts)[length], len(patterns))
    x = np.full(len(patterns), counts.sum() / max(1, len(length)))
    for _ in range(rounds):  # multiplicative steps keep x non-negative and lower the weighted squares
        covered = np.bincount(length, x[owner], len(counts))
        x *= target / np.maximum(np.bincount(owner, (weight * covered)[length], len(patterns)), 1e-12)
    return x


def plan(histogram: dict[int, int], limit: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Sequence types: (how many sequences, ((length, pieces of it in each), ...)); together they use every piece."""
    left = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    types: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    if left[limit]:
        types.append((int(left[limit]), ((limit, 1),)))
        left[limit] = 0
    patterns = _patterns(np.flatnonzero(left), limit, PATTERNS_PER_LENGTH)
    x = _fit(patterns, left.astype(float), ROUNDS)
    for k in range(len(patterns)):  # longest first, so the fillers go where there are fewest that fit
        parts, times = np.unique(np.asarray(patterns[k]), return_counts=True)
        n = int(min(round(float(x[k])), (left[parts] // times).min()))
        if n > 0:
            left[parts] -= n * times
            types.append((n, tuple((int(a), int(t)) for a, t in zip(parts[::-1], times[::-1]))))
    # best fit of the rest: open types by room
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}

    def add(room: int, n: int, runs: tuple[tuple[int, int], ...]) -> None:
        if room == 0:
            types.append((n, runs))
        elif room in open_:
            open_[room].append((n, runs))
        else:
            open_[room] = [(n, runs)]
            insort(rooms, room)

    for length in map(int, np.flatnonzero(left)[::-1]):
        need = int(left[length])
        while need:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = limit // length
                if need >= each:
                    add(limit - each * length, need // each, ((length, each),))
                if need % each:
                    add(limit - need % each * length, 1, ((length, need % each),))
                break
            room = rooms[at]
            n, runs = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = min(room // length, need)
            used = min(n, need // each)
            if used < n:
                add(room, n - used, runs)
            add(room - each * length, used, (*runs, (length, each)))
            need -= used * each
    types.extend(t for room in rooms for t in open_[room])
    return types


def _slots(types: list[tuple[int, tuple[tuple[int, int], ...]]]) -> dict[str, np.ndarray]:
    """Runs by (length, first rank): sequences from `sequence`, `each` pieces in each from `offset`."""
    cursor: dict[int, int] = {}
    rows, base = [], 0
    for n, runs in types:
        offset = 0
        for length, each in runs:
            first = cursor.get(length, 0)
            rows.append((length, first, base, each, offset))
            cursor[length] = first + n * each
            offset += length * each
        base += n
    table = np.asarray(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "first": table[:, 1], "sequence": table[:, 2],
            "each": table[:, 3], "offset": table[:, 4]}


def pack(parts: DataFrame, limit: int = 4096) -> DataFrame:
    """`parts` of `pieces`, with sequence_id and offset."""
    spark = parts.sparkSession
    path = fresh_path(spark, "pieces")
    parts.write.parquet(path)
    stored = spark.read.parquet(path)
    histogram = {r["length"]: r["count"] for r in stored.groupBy("length").count().collect()}
    slots = _slots(plan(histogram, limit))
    # buckets of each length by its own count, as one literal of at most `limit` numbers
    buckets = F.split(F.lit(",".join(str(histogram.get(n, 0) // BUCKET + 1) for n in range(limit + 1))), ",").cast("array<long>")
    bucket = F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), F.get(buckets, F.col("length").cast("int")))
    spread = stored.withColumn("bucket", bucket)
    sizes = spread.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")).alias("base"))
    # ranks within (length, bucket); the base makes them ranks within the length
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32"))
    ranked = spread.withColumn("rank", rank - 1).join(bases, ["length", "bucket"]).select(
        *parts.columns, (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            position = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(slots["key"], (length << 44) + position, side="right") - 1
            inside = position - slots["first"][at]
            each = slots["each"][at]
            sequence = slots["sequence"][at] + inside // each
            offset = slots["offset"][at] + inside % each * length
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                                             [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def packed_documents(df: DataFrame, vocabulary: str, limit: int = 4096, end: int = 1, id_col: str = "doc_id",
                     text: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of all documents."""
    return pack(pieces(df, vocabulary, limit, end, id_col, text, with_ids), limit).withColumnRenamed("id", id_col)
