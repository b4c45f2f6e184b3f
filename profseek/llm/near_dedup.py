"""MinHash near-duplicates: banded candidates, odd sketches to screen them, full shingle sets to decide.

1. Every document's shingle set is hashed; documents of equal sets form a class,
   and one of them stands for it.
2. MinHash samples give bands (candidates) and, folded into a parity bitmap, an
   odd sketch: the population count of the XOR of two sketches tells how many
   samples differ.
3. In every bucket that several classes share, all are compared with the
   smallest of them. Links found make components.
4. Classes of one bucket that are not yet in one component are compared with
   each other in blocks of bounded size. Pairs inside a component need no look,
   since only components are asked for, so a bucket of near copies costs its
   stragglers times its size. Sketches first discard what cannot be similar; the
   remaining pairs are counted on their full sets.
5. Components of all links, and from classes back to documents.

No bucket is capped. A pair at the threshold shares no band with probability
(1 - 0.8^5)^32 = 3e-6, less above it; the sketch misses it about as rarely.

Null and empty texts have no shingles and are linked with nothing; with fewer
words than a shingle has, the whole sequence is the one shingle. Rows that
repeat an id with an equal text stand or fall together. A null id links with
nothing and is kept. Empty tables give empty results; other columns never clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profseek.functions.shared import broadcast_if_small
from profseek.llm.components import components, stored
from profseek.llm.rows import packed, without_cycle_search
from profseek.llm.word_tokens import Memo

BANDS, ROWS = 32, 5
SKETCH_BITS = 512
#: Documents of one side of a block.
BLOCK = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _HALF)
    x = x * _MIX
    return x ^ (x >> _HALF)


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int):
        self.words = words
        self.hashes = Memo(xxhash.xxh64_intdigest, 500_000)

    def __call__(self, text: str | None) -> np.ndarray:
        found = (text or "").encode().lower().split()  # on bytes both know ASCII only
        if not found:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        width = min(self.words, len(h))
        n = len(h) - width + 1
        s = np.full(n, width, np.uint64)
        for k in range(width):
            s = _mixed(s * _ODD + h[k:k + n])
        s.sort()
        return s[np.concatenate(([True], s[1:] != s[:-1]))]


_SEEDS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _ODD) | np.uint64(1)


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples, one per seed."""
    best = None
    for k in range(0, len(shingles), 2048):
        x = shingles[k:k + 2048, None] * _SEEDS
        x ^= x >> _HALF
        x *= _MIX
        low = x.min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return best


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as bytes."""
    place = _mixed(sample + _SEEDS) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1)


def most_different_bits(similarity: float) -> int:
    """XOR population counts beyond this do not come from pairs of at least this similarity."""
    n = BANDS * ROWS
    differ = 2 * (n * (1 - similarity) + 5 * math.sqrt(n * similarity * (1 - similarity)))
    q = (1 - math.exp(-2 * differ / SKETCH_BITS)) / 2
    return math.ceil(SKETCH_BITS * q + 4 * math.sqrt(SKETCH_BITS * q * (1 - q)))


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, class, bands) of documents (id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingles(words)
        for batch in without_cycle_search(batches):
            n, keys, bands = [], [], []
            for value in batch.column(1):
                s = shingle(value.as_py())
                n.append(len(s))
                if not len(s):
                    keys.append(None)
                    bands.append(None)
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                rows = samples(s).reshape(BANDS, ROWS)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(ROWS):
                    key = _mixed(key * _ODD + rows[:, k])
                bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "class", "bands"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(sign, f"id {kind}, n long, class binary, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, sketch, shingles) of documents (id, text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingles(words)
        for batch in without_cycle_search(batches):
            found = [shingle(v.as_py()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([odd_sketch(samples(s)).tobytes() for s in found], pa.binary()),
                 pa.array([s.tobytes() for s in found], pa.binary())], ["id", "sketch", "shingles"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(build, f"id {kind}, sketch binary, shingles binary")


class _Block:
    """Compares the asking documents of a block with its others and joins their components."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bits = most_different_bits(percent / 100)

    def links(self, rows: list[tuple]) -> list[tuple[int, int]]:
        """Links that join two components; rows are (asks, id, component, sketch, shingles)."""
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        ids = [r[1] for r in rows]
        sketches = np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), -1)
        sizes = np.asarray([len(r[4]) // 8 for r in rows])
        postings = None
        out = []
        for at, (asks, own, component, _, shingles) in enumerate(rows):
            if not asks:
                continue
            bits = np.bitwise_count(sketches ^ sketches[at]).sum(axis=1)
            near = [k for k in np.flatnonzero(bits <= self.bits)
                    if k != at and (rows[k][0] == 0 or k > at) and find(rows[k][2]) != find(component)]
            if not near:
                continue
            if len(near) <= 4:
                mine = np.frombuffer(shingles, np.uint64)
                shared = [len(np.intersect1d(mine, np.frombuffer(rows[k][4], np.uint64), True)) for k in near]
            else:
                if postings is None:
                    every = np.frombuffer(b"".join(r[4] for r in rows), np.uint64)
                    order = np.argsort(every, kind="stable")
                    postings = every[order], np.repeat(np.arange(len(rows)), sizes)[order]
                mine = np.frombuffer(shingles, np.uint64)
                low, high = np.searchsorted(postings[0], mine, "left"), np.searchsorted(postings[0], mine, "right")
                length = high - low
                flat = np.repeat(low - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
                shared = np.bincount(postings[1][flat], minlength=len(rows))[near]
            for k, common in zip(near, shared):
                union = sizes[at] + sizes[k] - common
                if 100 * common >= self.percent * union and find(rows[k][2]) != find(component):
                    root[find(rows[k][2])] = find(component)
                    out.append((own, ids[k]))
        return out


def _linked(members: DataFrame, keys: list[str], sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among members (keys, asks, id, component) of equal keys."""
    spark = members.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = members.join(sets, "id").select(*keys, F.col("asks").cast("int").alias("asks"),
                                           "id", "component", "sketch", "shingles")
    rows = rows.repartition(n, *keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, last = _Block(percent), [], None

        def links(rows: list[tuple]) -> list[tuple[int, int]]:
            return block.links(rows) if len(rows) > 1 else []

        for batch in without_cycle_search(batches):
            found = []
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                key = row[:len(keys)]
                if key != last:
                    found += links(held)
                    held, last = [], key
                held.append(row[len(keys):])
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        found = links(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): documents linked by Jaccard similarities of at least percent / 100."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    signed = stored(_signatures(docs, words), "signatures")
    real = signed.filter(F.col("id").isNotNull() & F.col("class").isNotNull())
    classes = stored(real.groupBy("class").agg(F.min("id").alias("rep")), "classes")
    # one document stands for each class; repeated ids may stand twice and are compared as one
    reps = real.join(classes, "class").filter("id = rep").select("id", "bands")
    banded = stored(reps.select("id", F.posexplode("bands").alias("band", "bucket")).distinct(), "bands")
    shared = banded.groupBy("band", "bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(shared, "buckets")
    members = stored(banded.join(broadcast_if_small(shared), ["band", "bucket"]), "members")
    wanted = broadcast_if_small(stored(members.select("id").distinct(), "wanted"))
    sets = stored(_sets(docs.join(wanted, "id", "left_semi").dropDuplicates(["id"]), words), "sets")

    # all of a bucket with its smallest, in blocks of the pivot's members
    pairs = members.filter("id != pivot").select("pivot", "id").distinct()
    count = pairs.groupBy("pivot").count()
    dealt = pairs.join(count, "pivot").select(
        "pivot", F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / BLOCK)).alias("part"), "id")
    asking = dealt.select("pivot", "part").distinct().select("pivot", "part", F.lit(True).alias("asks"),
                                                             F.col("pivot").alias("id"))
    rows = asking.unionByName(dealt.withColumn("asks", F.lit(False))).withColumn("component", F.col("id"))
    first = stored(_linked(rows, ["pivot", "part"], sets, percent), "links")

    # what is left between components of one bucket
    known = stored(components(first), "components")
    inside = members.filter("id != pivot").join(known, F.col("id") == F.col("node"), "left").select(
        "band", "bucket", "id", F.coalesce("component", "id").alias("component"))
    inside = stored(inside, "inside")
    parts = inside.groupBy("band", "bucket", "component").count()
    per_bucket = parts.groupBy("band", "bucket").agg(
        F.sum("count").alias("n"), F.max(F.struct("count", "component")).alias("most"), F.count(F.lit(1)).alias("k"))
    open_ = per_bucket.filter("k > 1").select(
        "band", "bucket", F.col("most.component").alias("largest"), F.ceil(F.col("n") / BLOCK).alias("n_all"),
        F.ceil((F.col("n") - F.col("most.count")) / BLOCK).alias("n_asking"))
    met = inside.join(open_, ["band", "bucket"])
    salt = F.xxhash64("id", F.lit(1))
    every = met.select("band", "bucket", "id", "component", F.pmod(salt, F.col("n_all")).alias("part"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_asking") - 1)).alias("with"),
                       F.lit(False).alias("asks"))
    asking = met.filter("component != largest").select(
        "band", "bucket", "id", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_all") - 1)).alias("part"),
        F.pmod(salt, F.col("n_asking")).alias("with"), F.lit(True).alias("asks"))
    # a document that asks in its own block need not be there twice
    twice = every.join(asking.select("band", "bucket", "id", "part", "with"), ["band", "bucket", "id", "part", "with"],
                       "left_anti")
    second = stored(_linked(twice.unionByName(asking), ["band", "bucket", "part", "with"], sets, percent), "links")
    final = components(first.unionByName(second))

    named = classes.join(final, F.col("rep") == F.col("node"), "left").select(
        "class", F.coalesce("component", "rep").alias("component_id"))
    out = signed.join(named, "class", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_one(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of the smallest id of each group, with the columns they came with."""
    found = near_duplicates(df, words, percent, id_col, text)
    gone = found.filter(~F.col("kept")).select(F.col(id_col).cast("long").alias("gone")).distinct()
    rows = packed(df, id=id_col)
    return rows.join(gone, rows["id"].cast("long") == gone["gone"], "left_anti").select("row.*")
